"""The operators, each a function from DataFrames to a DataFrame."""

from kinweave.operators.bitmaps import (
    bitmap_build,
    bitmap_build_strings,
    bitmap_cardinality,
    bitmap_merge,
)
from kinweave.operators.containers import (
    container_build,
    container_bytes,
    container_cardinality,
    container_merge,
)
from kinweave.operators.graph import (
    chain_edges,
    chain_vertices_and_edges,
    connected_components,
    frequent_edges,
    id_vertices,
    pair_edges,
    vertices_and_edges,
)
from kinweave.operators.identity import (
    event_ids,
    extract_ids,
    id_mapping,
    id_mapping_rolling,
    tag_rows_with_guid,
)
from kinweave.operators.incremental import (
    DictionaryDelta,
    apply_delta,
    id_mapping_delta,
    id_mapping_incremental,
    merge_deltas,
)
from kinweave.operators.lookup import (
    append_lookup_text,
    keyed_lookup,
    position_lookup,
    range_lookup,
    range_lookup_asof,
    range_lookup_merged,
)
from kinweave.operators.pruning import frequent_pairs
from kinweave.operators.relational import (
    conjunctive_filter,
    sum_by_key,
    typed_projection,
    union_logs,
    word_count,
)
from kinweave.operators.resumable import (
    Resumed,
    block_runs,
    merge_runs,
    merge_summaries,
    resume_gap_sessions,
    resume_running_total,
    streak_summary,
)
from kinweave.operators.string_ids import (
    bitmap_build_exact,
    grow_string_ids,
    new_string_ids,
    read_string_ids,
)
from kinweave.operators.windows import (
    day_streaks,
    gap_sessions,
    previous_row,
    row_position,
    running_total,
    within_gap,
)

__all__ = [
    "DictionaryDelta",
    "Resumed",
    "append_lookup_text",
    "apply_delta",
    "bitmap_build",
    "bitmap_build_exact",
    "bitmap_build_strings",
    "bitmap_cardinality",
    "bitmap_merge",
    "block_runs",
    "chain_edges",
    "chain_vertices_and_edges",
    "conjunctive_filter",
    "connected_components",
    "container_build",
    "container_bytes",
    "container_cardinality",
    "container_merge",
    "day_streaks",
    "event_ids",
    "extract_ids",
    "frequent_edges",
    "frequent_pairs",
    "gap_sessions",
    "grow_string_ids",
    "id_mapping",
    "id_mapping_delta",
    "id_mapping_incremental",
    "id_mapping_rolling",
    "id_vertices",
    "keyed_lookup",
    "merge_deltas",
    "merge_runs",
    "merge_summaries",
    "new_string_ids",
    "pair_edges",
    "position_lookup",
    "previous_row",
    "range_lookup",
    "range_lookup_asof",
    "range_lookup_merged",
    "read_string_ids",
    "resume_gap_sessions",
    "resume_running_total",
    "row_position",
    "running_total",
    "streak_summary",
    "sum_by_key",
    "tag_rows_with_guid",
    "typed_projection",
    "union_logs",
    "vertices_and_edges",
    "within_gap",
    "word_count",
]
