"""Formula-retrieval analytics on PySpark DataFrames."""
