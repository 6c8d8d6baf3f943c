"""Compositions of operators: backup, masked restore, schema update, and their run log."""
