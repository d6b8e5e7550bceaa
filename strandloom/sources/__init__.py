"""Text formats as DataFrames, and DataFrames as their lines."""
