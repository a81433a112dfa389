"""Place, menu and review analytics as Spark DataFrame jobs."""
