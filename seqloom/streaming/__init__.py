"""Structured Streaming forms of what arrives as a stream: telemetry and new sequences."""
