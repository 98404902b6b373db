"""Readers, writers and the views that map the given tables to the shop's data model."""
