"""Scalar functions as Column builders, and the few that need Python."""
