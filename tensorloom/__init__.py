"""Array-dataflow analytics expressed as PySpark DataFrames."""
