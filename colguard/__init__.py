"""Declarative validation and normalization of nested records on Spark."""
