"""Point-in-time analytics and corpus operators as Spark DataFrame jobs."""
