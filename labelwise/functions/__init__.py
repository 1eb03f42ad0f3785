"""Column builders: text repair, span algebra, geometry and row predicates."""
