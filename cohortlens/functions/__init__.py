"""Column expressions: missing-value rules, code and text cleaning, label dimensions."""
