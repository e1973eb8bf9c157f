"""Readers and writers: variant calls, sample metadata, gene tables, file inventories."""
