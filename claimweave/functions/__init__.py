"""Column expressions with the study's rules for missing values, and distribution tails."""
