"""functions of the application-graph engine."""
