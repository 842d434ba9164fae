"""Column functions: signs and paths."""
