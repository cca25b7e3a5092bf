"""Column expressions: sequences, arrays, text parsing, numeric forms."""
