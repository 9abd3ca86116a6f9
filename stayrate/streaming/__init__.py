"""Structured Streaming upkeep of the usage signals and tier alerts."""
