"""functions of the point-cloud engine."""
