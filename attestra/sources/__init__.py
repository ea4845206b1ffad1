"""Files to DataFrames and back."""
