"""Set-level operators: DataFrames in, DataFrames out."""
