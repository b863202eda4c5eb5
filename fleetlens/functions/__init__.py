"""Column expressions: predicates, geometry, dates, texts."""
