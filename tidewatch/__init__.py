"""Event-stream risk forecasting on Spark DataFrames."""
