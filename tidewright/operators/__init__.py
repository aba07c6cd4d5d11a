"""Operators on series, snapshots, learned matrices and spectra."""
