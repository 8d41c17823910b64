"""Readers and writers of tables, manifests, caches and interaction records."""
