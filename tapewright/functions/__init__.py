"""Column functions and rule columns."""
