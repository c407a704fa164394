"""Readers and writers with schema guards."""
