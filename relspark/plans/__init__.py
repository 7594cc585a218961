"""Formulas, their rewriting and analysis, and their compilation to DataFrames."""
