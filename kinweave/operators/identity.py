"""Identity mapping: which identifiers belong to one person.

Identifiers seen together more often than a threshold are linked, linked identifiers form
a component, and the component's smallest identifier key is the person id (``guid``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import comma_fields, first_nonblank, nonblank_items, wide_key
from kinweave.operators.graph import (
    chain_vertices_and_edges,
    connected_components,
    vertices_and_edges,
)
from kinweave.operators.relational import union_logs
from kinweave.plans.joins import lookup_join
from kinweave.plans.storage import keeping_only, materialize
from kinweave.sources.readers import PHONE_ID_FIELDS, parse_event_log

KEY = "biaoshi_hashcode"
GUID = "guid"


def extract_ids(lines: DataFrame, text: str = "value") -> DataFrame:
    """Add ``ids``, the nonblank identifiers of a JSON log line in fixed field order.

    A line without user or phone gives what it has. A line that is no JSON gives no ids
    and keeps its text in ``corrupt``.
    """
    parsed = lines.withColumn("__log", parse_event_log(F.col(text)))
    return event_ids(parsed, "__log").drop("__log")


def event_ids(events: DataFrame, log: str | None = None) -> DataFrame:
    """Add ``ids`` and ``corrupt`` to parsed events, whose fields are columns or in struct ``log``."""
    at = "" if log is None else f"{log}."
    names = ["uid", *[f"phone.{f}" for f in PHONE_ID_FIELDS]]
    fields = F.array(*[F.col(f"{at}user.{n}") for n in names])
    return events.withColumn("ids", nonblank_items(fields)).withColumn("corrupt", F.col(f"{at}_corrupt"))


def _day_graph(
    logs: Sequence[DataFrame], more_than: int, key: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame]:
    """Vertices and supported edges of one day's logs."""
    ids = union_logs(*[log.select("ids") for log in logs])
    return vertices_and_edges(ids, key=key, more_than=more_than)


def _dictionary(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id").alias(KEY), F.col("component").alias(GUID))


def id_mapping(
    logs: Sequence[DataFrame],
    more_than: int = 2,
    key: Callable[[Column], Column] = wide_key,
) -> DataFrame:
    """Identifier dictionary ``(biaoshi_hashcode, guid)`` of one day.

    Each log has a column ``ids``. ``key`` maps an identifier to its key: ``wide_key`` has
    64 bits, ``lambda c: c`` keeps the text itself and never merges strangers, and
    ``java_hash`` gives the ids of a JVM job, whose 32 bits collide.
    """
    with keeping_only(logs[0].sparkSession) as kept:
        vertices, edges = _day_graph(logs, more_than, key)
        kept.append(connected_components(edges, vertices))
    return _dictionary(kept[0])


def id_mapping_rolling(
    logs: Sequence[DataFrame],
    previous: DataFrame,
    more_than: int = 2,
    key: Callable[[Column], Column] = wide_key,
) -> DataFrame:
    """Today's dictionary that keeps yesterday's person ids.

    The result is stored, and nothing else is left in storage. Yesterday's pairs join the graph whatever their support. A component takes the
    smallest guid that one of its identifiers had yesterday, or its own label when none
    had one. All of yesterday's identifiers stay in the dictionary.
    """
    with keeping_only(previous.sparkSession) as stored:
        vertices, edges = _day_graph(logs, more_than, key)
        links = previous.select(F.col(KEY).alias("src"), F.col(GUID).alias("dst"))
        old_ids = previous.select(F.col(KEY).alias("id"))
        labels = connected_components(edges.unionByName(links), vertices.unionByName(old_ids))
        known = labels.join(
            previous.select(F.col(KEY).alias("id"), F.col(GUID).alias("__old")), "id"
        )
        survivors = materialize(
            known.groupBy("component").agg(F.min("__old").alias("__guid")), "survivors"
        )
        settled = lookup_join(labels, survivors, ["component"]).select(
            F.col("id").alias(KEY), F.coalesce("__guid", "component").alias(GUID)
        )
        stored.append(materialize(settled, "dictionary"))
    return stored[0]


def tag_rows_with_guid(
    lines: DataFrame,
    text: str = "value",
    id_fields: Sequence[int] | None = None,
    key: Callable[[Column], Column] = wide_key,
    on_missing: str = "fail",
) -> DataFrame:
    """Prefix every raw line with the person id of its first nonblank identifier.

    Neighbouring identifiers of a line are linked. ``id_fields`` are the 0-based fields
    that hold identifiers; by default all do. A line without any identifier fails the
    job, or with ``on_missing='keep'`` stays with the text ``null``.
    """
    fields = comma_fields(text)
    if id_fields is not None:
        fields = F.array(*[F.get(fields, F.lit(i)) for i in id_fields])
    rows = lines.withColumn("fields", nonblank_items(fields))
    with keeping_only(lines.sparkSession) as kept:
        vertices, edges = chain_vertices_and_edges(rows, key=key)
        labels = connected_components(edges, vertices)
        kept.append(labels)
    tagged = lookup_join(
        rows.withColumn("id", key(first_nonblank("fields"))), labels, ["id"]
    )
    if on_missing == "fail":
        missing = F.raise_error(F.concat(F.lit("no identifier in line: "), F.col(text)))
    else:
        missing = F.lit("null")
    person = F.when(F.col("component").isNull(), missing).otherwise(
        F.col("component").cast("string")
    )
    return tagged.select(F.concat_ws(",", person, text).alias(text))
