"""DataFrame operators on run tables."""
