"""Geographic extracts and training-data operators on Spark DataFrames."""
