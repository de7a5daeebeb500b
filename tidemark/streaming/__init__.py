"""Incremental forms of what the batch plans compute; the batch at the end stays the reference."""
