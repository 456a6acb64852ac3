"""Retail analytics and daily demand forecasting on Spark DataFrames."""
