"""Cohort selection and data quality for family-based collections, on Spark DataFrames."""
