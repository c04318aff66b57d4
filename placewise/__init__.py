"""Field-location analytics as Spark DataFrame jobs."""
