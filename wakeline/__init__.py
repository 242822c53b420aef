"""wakeline: spatio-temporal attribution and data-audit operators on Spark DataFrames."""
