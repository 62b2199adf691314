"""Spark-native embedding of large point sets: cells, kernel graphs, grounded potentials, landmark placement."""
