"""Operators that clean and prepare text corpora; see `queries` for their registered forms."""
