"""Registered queries, each a callable of (spark, directory), and their SQL."""
