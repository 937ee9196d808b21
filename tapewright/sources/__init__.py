"""Readers, normalizers, sinks and retention of market tables."""
