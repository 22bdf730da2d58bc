"""Analytics for repeated-measurement experiments, written on Spark DataFrames."""
