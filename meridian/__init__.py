"""Spark-native analytics for ranked lookup, ordered chains, small graphs, grids and meshes."""
