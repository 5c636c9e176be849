"""Column functions: codes, names, numbers, geometry."""
