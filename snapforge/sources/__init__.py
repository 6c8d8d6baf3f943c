"""Readers: tables, database catalogs, snapshots, page JSON, files."""
