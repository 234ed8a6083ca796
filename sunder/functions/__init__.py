"""Column expressions and plan-time arithmetic."""
