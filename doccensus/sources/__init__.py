"""Readers, writers and keyed stores."""
