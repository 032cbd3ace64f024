"""Readers and writers of call set, interval, sequence and sample files."""
