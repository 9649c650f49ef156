"""Message-risk and writing-style analytics on Spark DataFrames."""
