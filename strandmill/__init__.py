"""A Spark engine for codon-level variant analytics, with operators for training-data pipelines."""
