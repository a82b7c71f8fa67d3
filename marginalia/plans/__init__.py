"""Planners, bindings to the driver's tables, and the query registry."""
