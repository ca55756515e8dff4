"""Column functions: labels, coercions, paths and sample arrays."""
