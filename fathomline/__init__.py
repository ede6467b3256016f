"""Part of the fathomline library."""
