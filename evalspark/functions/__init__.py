"""Column functions: hash draws, text and label helpers, vector helpers."""
