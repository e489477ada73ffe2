"""Micro-batch application of observations."""
