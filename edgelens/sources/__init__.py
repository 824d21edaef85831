"""Feeds landed as JSON, and the tables they accumulate in."""
