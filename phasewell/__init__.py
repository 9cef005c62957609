"""Spark-native analytics of I/O workloads: phases, placements, workflows."""
