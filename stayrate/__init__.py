"""Customer-retention analytics as distributed Spark jobs."""
