"""Operators over DataFrames of sequences, words, edges, clusters and terms."""
