"""Readers, writers and table-shaped stores."""
