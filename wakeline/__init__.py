"""wakeline: vessel-trajectory analytics as Spark DataFrame and streaming jobs."""
