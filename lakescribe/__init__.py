"""Document evidence at cluster scale, written as Spark jobs."""
