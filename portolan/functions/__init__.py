"""Column expressions: codes, arithmetic, labels."""
