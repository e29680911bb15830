"""Expression, pattern and text analytics as Spark jobs."""
