"""Identity mapping from day to day without redoing the past.

A dictionary holds every identifier's person; a day brings few of them. The day's edges are
mapped onto the persons that yesterday's dictionary has already, which contracts each of them
to one vertex, and components are solved on that quotient graph alone. What changes is small: new
identifiers, and old persons that turned out to be one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import wide_key
from kinweave.operators.graph import connected_components, vertices_and_edges
from kinweave.operators.identity import GUID, KEY
from kinweave.operators.relational import union_logs
from kinweave.plans.joins import fits_broadcast, lookup_join
from kinweave.plans.storage import keeping_only, materialize


class DictionaryDelta(NamedTuple):
    """What a day changes: rows ``(biaoshi_hashcode, guid)`` of new identifiers, and persons
    ``(guid, new_guid)`` that go on under another id."""

    added: DataFrame
    moved: DataFrame


def _known_ids(ids: DataFrame, previous: DataFrame) -> DataFrame:
    """``(id, person)`` of the day's identifiers that the dictionary has.

    A day that fits is broadcast, so the dictionary is scanned and not shuffled.
    """
    old = previous.select(F.col(KEY).alias("id"), F.col(GUID).alias("person"))
    return old.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "id")


def id_mapping_delta(
    logs: Sequence[DataFrame],
    previous: DataFrame,
    more_than: int = 2,
    key: Callable[[Column], Column] = wide_key,
) -> DictionaryDelta:
    """What the day's logs change in yesterday's dictionary; both tables are stored.

    ``previous`` is one that ``id_mapping``, ``id_mapping_rolling`` or ``apply_delta`` made:
    every person's id is one of that person's identifiers. It is read once, for a join
    with the day's distinct identifiers; the components run over edges between the persons
    and new identifiers of the day.
    """
    with keeping_only(previous.sparkSession) as kept:
        ids = union_logs(*[log.select("ids") for log in logs])
        vertices, edges = vertices_and_edges(ids, key=key, more_than=more_than)
        known = materialize(_known_ids(vertices, previous), "known_ids")
        links = edges
        for end in ("src", "dst"):
            found = known.select(F.col("id").alias(end), F.col("person").alias("__person"))
            links = lookup_join(links, found, [end]).withColumn(end, F.coalesce("__person", end)).drop("__person")
        quotient = links.where("src <> dst").select("src", "dst").distinct()
        labels = connected_components(quotient)

        persons = known.select(F.col("person").alias("id")).distinct().withColumn("__old", F.lit(True))
        members = materialize(lookup_join(labels, persons, ["id"]), "quotient")
        survivors = members.groupBy("component").agg(
            F.coalesce(F.min(F.when(F.col("__old"), F.col("id"))), F.first("component")).alias("guid")
        )
        settled = materialize(lookup_join(members, survivors, ["component"]), "settled")
        kept.append(
            materialize(
                settled.where(F.col("__old") & (F.col("id") != F.col("guid"))).select(
                    F.col("id").alias(GUID), F.col("guid").alias("new_guid")
                ),
                "moved_persons",
            )
        )
        fresh = vertices.join(known.select("id"), "id", "left_anti")
        new_persons = settled.where(F.col("__old").isNull()).select("id", "guid")
        kept.append(
            materialize(
                lookup_join(fresh, new_persons, ["id"]).select(
                    F.col("id").alias(KEY), F.coalesce("guid", "id").alias(GUID)
                ),
                "added_ids",
            )
        )
    return DictionaryDelta(added=kept[1], moved=kept[0])


def apply_delta(previous: DataFrame, delta: DictionaryDelta) -> DataFrame:
    """The dictionary after the day: moved persons renamed where they stand, new rows added.

    ``moved`` is looked up by a broadcast where it measures small, so the dictionary is not
    shuffled. The result is a plan over the stored tables: write it, or apply the next
    day's delta to it and write the dictionary once in a while.
    """
    renamed = lookup_join(previous, delta.moved, [GUID]).select(
        KEY, F.coalesce("new_guid", GUID).alias(GUID)
    )
    return renamed.unionByName(delta.added)


def merge_deltas(deltas: Sequence[DictionaryDelta]) -> DictionaryDelta:
    """Several days' deltas as one, so a stored dictionary is joined once for all of them.

    A person moves to the smallest id of those that turned out to be one, day after day, so
    where the moves lead is the smallest id that they connect. Both tables are stored.
    """
    with keeping_only(deltas[0].added.sparkSession) as kept:
        moves = union_logs(*[d.moved.select(F.col(GUID).alias("src"), F.col("new_guid").alias("dst")) for d in deltas])
        labels = connected_components(moves)
        moved = labels.where("id <> component").select(
            F.col("id").alias(GUID), F.col("component").alias("new_guid")
        )
        kept.append(materialize(moved, "moved_persons"))
        added = union_logs(*[d.added for d in deltas])
        renamed = lookup_join(added, kept[0], [GUID]).select(KEY, F.coalesce("new_guid", GUID).alias(GUID))
        kept.append(materialize(renamed, "added_ids"))
    return DictionaryDelta(added=kept[1], moved=kept[0])


def id_mapping_incremental(
    logs: Sequence[DataFrame],
    previous: DataFrame,
    more_than: int = 2,
    key: Callable[[Column], Column] = wide_key,
) -> DataFrame:
    """The rows of ``id_mapping_rolling`` by way of the day's delta."""
    return apply_delta(previous, id_mapping_delta(logs, previous, more_than, key))
