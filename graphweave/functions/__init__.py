"""Column helpers: typed literals, typed nulls, error rows."""
