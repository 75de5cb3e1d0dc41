"""Training-data operators: scoring, fingerprints, archives, joins, dedup and encoding."""
