"""Column functions on text, JSON and vectors."""
