"""Spark-first analytics over evidence extracted from research documents."""
