"""Column functions and distributed building blocks."""
