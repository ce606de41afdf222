"""Order-booking analytics on Spark DataFrames."""
