"""Column expressions: end-state labels, fixed-width bins, casts, exact sums, shares."""
