"""operators of the point-cloud engine."""
