"""Record-linkage operators: DataFrames in, DataFrames out."""
