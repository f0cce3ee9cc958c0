"""Structured Streaming: slices that arrive as files are measured once each."""
