"""Directory building, enrichment, checking and search as Spark DataFrame operators."""
