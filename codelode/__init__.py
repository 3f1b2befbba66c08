"""Code mining and task-to-code retrieval as Spark DataFrame jobs."""
