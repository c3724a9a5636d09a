"""Spark-native colour refinement of labelled graph collections, with graph kernels and nested cross-validation."""
