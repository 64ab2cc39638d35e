"""Column functions: statistics, text and scores, all of built-in expressions."""
