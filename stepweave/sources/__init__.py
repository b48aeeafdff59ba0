"""sources of the application-graph engine."""
