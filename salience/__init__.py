"""Building and evaluating text-summarization data with Spark DataFrames."""
