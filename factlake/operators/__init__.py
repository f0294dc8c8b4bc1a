"""Relational operators: keyed reads, joins, metrics, ordered rows, versions, checks. Each takes and returns DataFrames."""
