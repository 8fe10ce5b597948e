"""Landed files in, result tables out, and the stand-in market over the given tables."""
