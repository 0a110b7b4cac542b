"""Column expressions and value codecs."""
