"""Reports over small results."""
