"""Readers, snapshots and writers."""
