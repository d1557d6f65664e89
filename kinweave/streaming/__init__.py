"""Structured Streaming jobs: files taken in as they arrive."""

from kinweave.streaming.intake import read_corrupt_lines, read_intake, take_in_logs

__all__ = ["read_corrupt_lines", "read_intake", "take_in_logs"]
