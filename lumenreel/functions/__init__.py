"""Column functions: names, bytes, codec strings and display text."""
