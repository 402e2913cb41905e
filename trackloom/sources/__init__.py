"""sources of the trajectory engine."""
