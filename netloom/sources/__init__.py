"""Schemas, readers and writers of landed data, and the scenario that stands in for it."""
