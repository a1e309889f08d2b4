"""Spark-first engine for cleaning, reconciling and explaining business tables."""
