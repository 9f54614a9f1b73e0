"""Kantar: retail price and basket analytics on PySpark DataFrames."""
