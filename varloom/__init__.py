"""Corpus-scale static analysis of CSS custom properties on Spark DataFrames."""
