"""Whole jobs: prompted evaluation, training, scoring."""
