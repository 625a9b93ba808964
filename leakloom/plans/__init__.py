"""Whole scans, and the registered queries."""
