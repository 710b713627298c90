"""Landed feed records as payload rows."""
