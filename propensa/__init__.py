"""Customer purchase-propensity analytics on Spark DataFrames."""
