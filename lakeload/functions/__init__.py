"""Column functions and name rules."""
