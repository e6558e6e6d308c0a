"""Batch runs over a rule catalogue, and the registered queries."""
