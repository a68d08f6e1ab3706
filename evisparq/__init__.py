"""evisparq: retrieval, evidence and evaluation operators on PySpark DataFrames."""
