"""ridgeline — membership and activity analytics as Spark DataFrame jobs."""
