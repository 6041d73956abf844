"""Whole jobs built from operators, and the registered queries."""
