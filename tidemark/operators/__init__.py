"""Operators: quality checks, adjustment, features, labels, selection, metrics, models."""
