"""Anomalous-community analytics and training-data operators on PySpark DataFrames."""
