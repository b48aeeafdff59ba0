"""plans of the application-graph engine."""
