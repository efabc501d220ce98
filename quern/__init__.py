"""Quern: text retrieval, corpus preparation and log analytics on plain Spark DataFrames."""
