"""Readers and writers of the crawl tables and of the event log."""
