"""Training-data operators: search, extraction, scanning, joins, dedup, packing, scoring, archives, mixing."""
