"""Column expressions: plate grammar, geometry, statistics."""
