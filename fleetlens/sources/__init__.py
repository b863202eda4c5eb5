"""Readers of the CSV, log, JSON and binary row contracts, and the sinks."""
