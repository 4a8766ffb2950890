"""Catalog analytics and entity resolution for disk-image collections on PySpark."""
