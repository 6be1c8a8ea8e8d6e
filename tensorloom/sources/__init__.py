"""Scans, generators, sinks and shared storage."""
