"""Whole plans: the ranking run, the views over the driver's tables, and the query catalogue."""
