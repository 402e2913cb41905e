"""functions of the trajectory engine."""
