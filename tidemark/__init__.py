"""Social-stream and corpus analytics on Spark DataFrames."""
