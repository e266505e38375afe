"""Live twins of the table jobs, as Structured Streaming queries."""
