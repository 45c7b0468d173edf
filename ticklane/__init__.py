"""Driving-telemetry analytics as Spark jobs."""
