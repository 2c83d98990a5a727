"""Registered queries and composed audit plans."""
