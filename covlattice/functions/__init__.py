"""Column functions: lookups, scalar maths, packed bit sets, text."""
