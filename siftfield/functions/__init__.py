"""Column functions that the operators are built from."""
