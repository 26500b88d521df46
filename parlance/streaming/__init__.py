"""Bulk and streaming use of the planner and of compiled plans."""
