"""Relational operators over sessions, samples, windows, scores and events."""
