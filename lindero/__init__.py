"""Lindero: property-listing analytics as Spark jobs."""
