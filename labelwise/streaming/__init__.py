"""Structured Streaming jobs over frames and run logs."""
