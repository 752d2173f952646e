"""Spark-native engine for privacy-preserving conversation processing."""
