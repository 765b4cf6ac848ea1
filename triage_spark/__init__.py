"""Spark-native ticket triage engine."""
