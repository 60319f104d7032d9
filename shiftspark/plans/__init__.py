"""Compositions of operators into whole monitoring jobs."""
