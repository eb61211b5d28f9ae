"""Structured Streaming jobs; each has a batch form that gives the same rows."""
