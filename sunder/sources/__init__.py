"""Readers of test tables and files."""
