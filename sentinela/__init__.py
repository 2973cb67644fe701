"""Disease-surveillance analytics expressed as Spark DataFrame jobs."""
