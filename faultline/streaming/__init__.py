"""The incident monitor on Structured Streaming."""
