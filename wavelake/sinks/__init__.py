"""Sinks: cached tables by content key, JSON documents, CSV, Markdown."""
