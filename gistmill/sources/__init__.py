"""Readers and writers of requests, sessions, tables of originals, memories and fixtures."""
