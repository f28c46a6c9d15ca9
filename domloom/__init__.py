"""HTML at scale on PySpark."""
