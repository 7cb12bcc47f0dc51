"""Readers and writers: incident tables, event reports, drop folders, feeds, the alert log."""
