"""strataq: source-code analytics on Spark DataFrames."""
