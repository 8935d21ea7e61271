"""Whole reporting runs, views over the driver tables, and the query catalogue."""
