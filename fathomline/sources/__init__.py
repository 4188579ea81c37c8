"""Readers, sinks and state tables."""
