"""phenorank: annotated-profile ranking and training-data preparation on Spark DataFrames."""
