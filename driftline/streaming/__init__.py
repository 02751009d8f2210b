"""Frames that arrive as a stream: running results in Structured Streaming."""
