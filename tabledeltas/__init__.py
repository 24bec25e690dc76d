"""Keyed topics to latest-value tables, and SQL results over them to keyed change feeds."""
