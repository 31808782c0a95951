"""Structured Streaming forms of the session, store and totals operators."""
