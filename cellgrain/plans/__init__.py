"""Analyses made of several operators: column profiles, schema inference, overviews."""
