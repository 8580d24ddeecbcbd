"""inkstone: Chinese text analytics on Spark DataFrames."""
