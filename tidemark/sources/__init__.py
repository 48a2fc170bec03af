"""Readers for landed payloads and writers for partitioned tables."""
