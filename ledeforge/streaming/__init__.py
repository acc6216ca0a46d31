"""Alerts over polled rankings and event streams."""
