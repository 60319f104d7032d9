"""The checks on streams of observations."""
