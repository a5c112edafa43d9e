"""Whole plans: the corpus run, and the catalogue of queries."""
