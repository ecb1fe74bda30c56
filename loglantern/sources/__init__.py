"""Readers and writers for the log, vector and model tables."""
