"""DataFrame operators for point-in-time time-series analytics."""
