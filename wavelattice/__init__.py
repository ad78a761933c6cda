"""Analytics on multi-channel array recordings, held as Spark DataFrames."""
