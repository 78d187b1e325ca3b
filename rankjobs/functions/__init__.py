"""Column-in, column-out functions."""
