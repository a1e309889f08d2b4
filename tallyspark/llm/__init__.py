"""Operators for building training data: filters, joins, sharding, mixing, archives and media."""
