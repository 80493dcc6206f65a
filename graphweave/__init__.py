"""Federated typed-graph queries on Spark."""
