"""Scans, sinks and the mappings from the star-schema tables to the credit domain."""
