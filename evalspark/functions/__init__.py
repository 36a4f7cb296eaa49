"""Column expressions: hashing, text, numbers and the fixed values they share."""
