"""Column expressions and binary codecs."""
