"""Article policy analytics and corpus preparation as plain Spark jobs."""
