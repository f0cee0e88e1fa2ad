"""Space x time x trial decoding analytics as Spark DataFrame jobs."""
