"""Reading, parsing, validating and writing tables."""
