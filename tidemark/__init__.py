"""Set-wise market-signal analytics on Spark DataFrames."""
