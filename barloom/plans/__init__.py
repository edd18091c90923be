"""Syntax, checks and domains."""
