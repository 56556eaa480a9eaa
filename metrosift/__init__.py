"""Market screening and fleet-log analytics as Spark DataFrame jobs."""
