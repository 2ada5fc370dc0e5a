"""Registered queries of the graph engine."""
