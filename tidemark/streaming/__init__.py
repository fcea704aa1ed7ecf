"""The same operators in Structured Streaming."""
