"""Time-series analytics and forecasting on Spark DataFrames."""
