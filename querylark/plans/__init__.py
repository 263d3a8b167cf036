"""Clauses to Spark columns."""
