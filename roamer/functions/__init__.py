"""Column functions: geometry, quadtree, time of day, statistics."""
