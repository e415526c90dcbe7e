"""Analytics over filesystem snapshots with Spark DataFrames."""
