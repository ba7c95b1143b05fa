"""Fixed-frequency time series with missing values as lazy Spark DataFrames."""
