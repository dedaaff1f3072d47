"""Column expressions and skew-safe ordering helpers shared by the operators."""
