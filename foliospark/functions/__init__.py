"""Column functions: text, hashes, dates."""
