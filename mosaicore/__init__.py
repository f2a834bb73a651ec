"""Self-similarity (fractal) image coding and analytics on Spark DataFrames."""
