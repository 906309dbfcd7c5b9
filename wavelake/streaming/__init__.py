"""Structured Streaming: event-time windows with watermarks, stateful alerts, ring-buffer windows."""
