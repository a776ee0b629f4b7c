"""Live figures of a run as Structured Streaming queries."""
