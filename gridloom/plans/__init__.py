"""Whole jobs composed from operators: labels, statistics, composites, scoring."""
