"""Continuous-integration result analytics on PySpark DataFrames."""
