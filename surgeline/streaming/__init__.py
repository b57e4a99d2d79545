"""The same logic on streams of readings."""
