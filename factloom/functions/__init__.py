"""Column functions: text helpers and value normalization."""
