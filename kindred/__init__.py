"""kindred: record linkage and evidence scoring on Spark DataFrames."""
