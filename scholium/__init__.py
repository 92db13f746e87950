"""Literature mining on PySpark: bibliographies, citations and glossed examples as DataFrames."""
