"""Tidewheel: PySpark jobs that turn noisy posts into clean, deduplicated offers."""
