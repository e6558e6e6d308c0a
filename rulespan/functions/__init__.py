"""Column expressions and row preparation shared by the operators."""
