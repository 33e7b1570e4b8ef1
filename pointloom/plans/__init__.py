"""plans of the point-cloud engine."""
