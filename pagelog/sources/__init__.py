"""Readers and writers of log files, write-ahead logs and images."""
