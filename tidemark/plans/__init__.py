"""Whole runs, and the registry of queries."""
