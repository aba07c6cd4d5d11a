"""Whole analyses: configuration, dispatch and figure tables."""
