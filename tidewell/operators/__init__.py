"""Jobs on tables of points, units and trials."""
