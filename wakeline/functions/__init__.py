"""Column functions and distributed helpers."""
