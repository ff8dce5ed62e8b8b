"""Paired-measurement analytics as DataFrame operators on Spark."""
