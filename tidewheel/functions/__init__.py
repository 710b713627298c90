"""Column functions: text, URLs, signals, offers, vectors."""
