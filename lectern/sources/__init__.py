"""Readers, writers and the views that the registered queries use."""
