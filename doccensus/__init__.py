"""Audit documentation sites at corpus scale with Spark DataFrames."""
