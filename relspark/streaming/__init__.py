"""Programs that run tick by tick on Structured Streaming."""
