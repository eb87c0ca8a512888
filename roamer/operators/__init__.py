"""DataFrame operators of mobility analytics."""
