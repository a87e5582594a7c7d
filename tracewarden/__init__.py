"""Audit analytics for AI-agent telemetry, written as Spark DataFrame functions."""
