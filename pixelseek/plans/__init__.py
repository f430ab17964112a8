"""Composite jobs: what a user calls."""
