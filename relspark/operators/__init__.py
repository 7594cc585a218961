"""Relational, aggregate, ordered, recursive and graph operators over DataFrames with set semantics."""
