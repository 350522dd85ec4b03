"""Column expressions: text cleansing, play classification, rate statistics."""
