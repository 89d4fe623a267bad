"""Sinks of predictions, reports and logs."""

from .files import append_new, error_cases, read_log, record_ids, retire, write_csv, write_error_cases, write_pairs, write_predictions, write_summary, write_text

__all__ = ["append_new", "error_cases", "read_log", "record_ids", "retire", "write_csv", "write_error_cases", "write_pairs", "write_predictions", "write_summary", "write_text"]
