"""Operators on DataFrames: curation, matching, similarity, splits, counts, language model, metrics, noise, stages."""
