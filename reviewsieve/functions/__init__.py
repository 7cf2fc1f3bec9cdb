"""Column expressions and ranking helpers shared by all operators."""
