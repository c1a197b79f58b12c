"""legajo: document analytics and retrieval on PySpark DataFrames."""
