"""Cohort, design and estimation operators: DataFrames in, DataFrames out."""
