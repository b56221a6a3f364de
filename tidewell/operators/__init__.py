"""Relational operators: browsing, joins, aggregations, windows, matching and merging."""
