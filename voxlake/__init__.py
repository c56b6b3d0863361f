"""Customer-feedback analytics expressed as Spark DataFrame jobs."""
