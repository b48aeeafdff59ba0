"""Scanner outputs as a stream into the graph."""
