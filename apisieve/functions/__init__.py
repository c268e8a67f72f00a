"""Column expressions and the Arrow functions they need."""
