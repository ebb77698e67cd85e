"""Column expressions: dates, hours, text, rules, scoring, vectors."""
