"""Column expressions: cell text, cleaning rules, dates, nested values."""
