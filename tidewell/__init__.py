"""Spark jobs that find which event streams drive each other, over many units and many repeated trials."""
