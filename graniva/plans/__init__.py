"""Staging helpers, and the registered queries with their SQL."""
