"""genoframe: sequence containers and sequence analytics as Spark DataFrames."""
