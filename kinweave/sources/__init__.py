"""Readers and writers: text, delimited, JSON logs, Parquet, JDBC, literal sequences."""

from kinweave.sources.bucketed import bucketed_lookup, open_bucketed, write_bucketed
from kinweave.sources.readers import (
    DICTIONARY_SCHEMA,
    EVENT_LOG_SCHEMA,
    jdbc_options,
    read_delimited,
    read_dictionary,
    read_event_log,
    read_jdbc,
    read_parquet,
    read_side_table,
    read_text,
    sequence,
)
from kinweave.sources.sized import compact_files, write_sized
from kinweave.sources.writers import write_parquet, write_text

__all__ = [
    "DICTIONARY_SCHEMA",
    "EVENT_LOG_SCHEMA",
    "bucketed_lookup",
    "compact_files",
    "jdbc_options",
    "open_bucketed",
    "read_delimited",
    "read_dictionary",
    "read_event_log",
    "read_jdbc",
    "read_parquet",
    "read_side_table",
    "read_text",
    "sequence",
    "write_bucketed",
    "write_parquet",
    "write_sized",
    "write_text",
]
