"""Underground-tunnel risk analytics as Spark DataFrame jobs."""
