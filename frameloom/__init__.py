"""frameloom: frame-level time-series analytics on PySpark DataFrames."""
