"""Column functions: text, numbers, addresses, statistics."""
