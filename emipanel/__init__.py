"""Spark jobs for building, checking and evaluating annual emission panels."""
