"""Spark jobs over wind-session logs and document collections."""
