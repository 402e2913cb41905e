"""streaming of the trajectory engine."""
