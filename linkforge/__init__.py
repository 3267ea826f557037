"""Spark-native record linkage: noisy records are linked to a clean master list."""
