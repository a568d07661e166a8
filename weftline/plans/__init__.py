"""Whole plans: the build, the warehouse, the registered queries."""
