"""Plan cluster runs of large data jobs with Spark DataFrames."""
