"""Column functions: lists, arithmetic by mode, order of terms, text search."""
