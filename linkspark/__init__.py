"""linkspark: record linkage and analytics as PySpark DataFrame operations."""
