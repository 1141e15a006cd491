"""Column expressions: text, JSON, geography, classification, vectors."""
