"""Readers, writers and the stored baseline profile."""
