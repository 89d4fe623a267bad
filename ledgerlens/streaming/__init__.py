"""Structured Streaming: files of predictions as they arrive, the last answer of each key as state, and windows over events."""

from .journal import closed_windows, events_by_window, latest_answers, read_latest, resume_predictions

__all__ = ["closed_windows", "events_by_window", "latest_answers", "read_latest", "resume_predictions"]
