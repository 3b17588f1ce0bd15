"""Queries over the given tables, each with its SQL, and workflows of several jobs."""
