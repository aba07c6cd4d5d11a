"""Fits that follow a stream."""
