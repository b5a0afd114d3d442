"""tracemill: session-log analytics as Spark jobs."""
