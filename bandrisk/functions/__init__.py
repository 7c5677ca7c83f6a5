"""Column expressions and the small fixed dimensions they are built from."""
