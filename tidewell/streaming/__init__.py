"""Binned counts of a stream of points."""
