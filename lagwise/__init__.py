"""Event-related regression and text preparation on Spark DataFrames."""
