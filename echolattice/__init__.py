"""Fingerprint search over time-frequency data, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
