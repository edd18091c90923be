"""Arithmetic, intervals and identities."""
