"""Temporal multilayer network analytics on PySpark."""
