"""Table operators: each takes and returns Spark DataFrames."""
