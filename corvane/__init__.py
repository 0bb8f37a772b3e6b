"""Document retrieval, ranking evaluation and retrieval monitoring on Spark DataFrames."""
