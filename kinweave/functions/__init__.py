"""Column-in, column-out expressions."""

from kinweave.functions.scalars import (
    comma_fields,
    compare_to_range,
    contains_literal,
    count_at_most,
    first_nonblank,
    is_nonblank,
    java_hash,
    nonblank_items,
    tokens,
    url_host,
    wide_key,
    within_seconds,
)

__all__ = [
    "comma_fields",
    "compare_to_range",
    "contains_literal",
    "count_at_most",
    "first_nonblank",
    "is_nonblank",
    "java_hash",
    "nonblank_items",
    "tokens",
    "url_host",
    "wide_key",
    "within_seconds",
]
