"""Knowledge compilation, hybrid retrieval and corpus preparation on Spark DataFrames."""
