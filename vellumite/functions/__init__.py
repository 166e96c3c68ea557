"""Column expressions: text, numbers, geometry, image plans."""
