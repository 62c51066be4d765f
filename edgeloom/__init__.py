"""K-truss analytics on DataFrames."""
