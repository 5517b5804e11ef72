"""Document analytics on PySpark: search, ingest, aggregation, scoring and streaming over DataFrames."""
