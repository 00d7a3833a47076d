"""Sequence records, motifs, enzymes and matches as Spark DataFrames."""
