"""Column functions of the library part."""
