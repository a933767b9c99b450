"""Talk-popularity analytics as Spark DataFrame jobs."""
