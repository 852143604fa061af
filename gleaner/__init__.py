"""Record-quality and corpus analytics on Spark DataFrames."""
