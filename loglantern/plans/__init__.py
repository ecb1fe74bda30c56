"""Operators put together into the jobs a user runs, and the query catalogue."""
