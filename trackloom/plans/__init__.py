"""plans of the trajectory engine."""
