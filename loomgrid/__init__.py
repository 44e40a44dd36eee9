"""Spatial event-interaction analytics on Spark."""
