"""tkanyna: parallel-corpus analytics on Spark DataFrames."""
