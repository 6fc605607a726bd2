"""Global ordering, ranking and balanced placement for PySpark DataFrames."""
