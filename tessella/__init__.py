"""Tessella: project-scoped knowledge-base analytics as Spark DataFrame functions."""
