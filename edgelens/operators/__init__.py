"""Relational and model operators over the tables."""
