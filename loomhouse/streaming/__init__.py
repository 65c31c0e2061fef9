"""Loading from Structured Streaming."""
