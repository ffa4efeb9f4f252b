"""Screening, searching, scoring and ranking of text documents on PySpark."""
