"""Lap timing and telemetry analytics on Spark."""
