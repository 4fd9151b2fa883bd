"""Detector evaluation and code-audit analytics on Spark."""
