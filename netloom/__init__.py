"""Spark-native engine for network-inventory and vulnerability-graph data."""
