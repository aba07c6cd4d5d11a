"""Generators of trajectory tables and snapshot pairs."""
