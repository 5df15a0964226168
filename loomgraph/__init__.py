"""Architecture-graph analytics on PySpark DataFrames."""
