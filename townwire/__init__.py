"""Spark-first rule-cascade classification, indexing and ranking of short posts."""
