"""Event-sequence valuation and training-data operators on Spark DataFrames."""
