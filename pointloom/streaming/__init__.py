"""streaming of the point-cloud engine."""
