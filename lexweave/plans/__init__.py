"""Queries that bind the operators to the tables."""
