"""Readers and writers for trace tables."""
