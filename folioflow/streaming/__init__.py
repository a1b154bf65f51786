"""The time-driven parts as Structured Streaming jobs."""
