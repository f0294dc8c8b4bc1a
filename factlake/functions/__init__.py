"""Column functions on text, numbers, dates, URLs and JSON."""
