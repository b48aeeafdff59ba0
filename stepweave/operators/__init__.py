"""operators of the application-graph engine."""
