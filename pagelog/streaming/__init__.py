"""Capture of write-ahead logs as a stream."""
