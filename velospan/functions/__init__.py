"""Column expressions: text keys, clock arithmetic, route geometry."""
