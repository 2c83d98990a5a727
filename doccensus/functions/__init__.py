"""Column expressions: URL, HTML and text features."""
