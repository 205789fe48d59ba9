"""Spark operators for video-derived tables: identity, sequences, windows, quality, telemetry, provenance."""

__version__ = "0.1.0"
