"""Spark jobs over an archive of case files."""
