"""Structured Streaming forms of the log and corpus operators (ST1-ST6)."""
