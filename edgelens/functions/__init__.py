"""Column expressions: time text, guarded arithmetic, presentation."""
