"""Specification-evidence and corpus jobs on Spark."""
