"""Column functions: geometry and time values, predicates, distances, text forms, SQL registration."""
