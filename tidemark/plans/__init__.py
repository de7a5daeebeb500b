"""Plans: rules over operators, the findings relation, the query catalogue."""
