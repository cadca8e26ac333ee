"""Readers and the shared work folder."""

from seqloom.sources.tables import discard, read_table, spread, stage, work_dir

__all__ = ["discard", "read_table", "spread", "stage", "work_dir"]
