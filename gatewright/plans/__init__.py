"""Whole jobs over many repositories and runs."""
