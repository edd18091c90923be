"""Lowering, folds and execution of queries."""
