"""Coverage, detection and paired-experiment analytics on Spark DataFrames."""
