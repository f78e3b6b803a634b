"""Column expressions: names, labels, strata, time."""
