"""Column functions, and small NumPy helpers for tails, bases and solves."""
