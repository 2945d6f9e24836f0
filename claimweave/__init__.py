"""Claims-style cohort analytics as PySpark DataFrame operators."""
