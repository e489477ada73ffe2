"""Content-catalog analytics on PySpark."""
