"""Column functions: expressions, normalisation of raw samples, numerics."""
