"""Spark-native semantic analytics: governed requests, profiling, text-to-knowledge, graph and scoring operators."""
