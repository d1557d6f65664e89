"""Graphs as DataFrames: vertices ``(id, value)``, edges ``(src, dst)``, component labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import nonblank_items, wide_key
from kinweave.operators.relational import explode_items
from kinweave.plans.joins import ROWS_PER_TASK, shuffled_lookup
from kinweave.plans.storage import discard, keeping_only, materialize, small_tasks


def id_vertices(
    df: DataFrame, ids: str = "ids", key: Callable[[Column], Column] = wide_key
) -> DataFrame:
    """One ``(id, value)`` row per identifier in the arrays."""
    return explode_items(df, ids, "value").select(key(F.col("value")).alias("id"), "value")


# More identifiers in one row than this fail the job: their pairs would be half its square.
MAX_IDS_PER_ROW = 2_000


def _keys(df: DataFrame, items: Column | str, key: Callable[[Column], Column]) -> DataFrame:
    """Column ``__keys``: the hashed identifiers of each row.

    The arrays leave an explode of one item each. No expression is inlined and no inferred
    filter pushed through it, so what makes the identifiers (a parse of JSON, say) is part of
    the plan once, however often the keys are named above.
    """
    return df.select(F.explode(F.array(F.transform(items, lambda item: key(item)))).alias("__keys"))


def _pairs(hashed: DataFrame, with_self: bool) -> DataFrame:
    """Rows (src, dst) for the pairs i < j of each array, in array order.

    ``with_self`` adds (item, null) for each item. Two explodes of the row's own array
    run inside generated code, unlike nested lambdas.
    """
    kind = hashed.schema["__keys"].dataType
    too_long = F.concat(F.lit("too many identifiers in one row: "), F.size("__keys"))
    bounded = F.when(
        F.size("__keys") > MAX_IDS_PER_ROW, F.raise_error(too_long).cast(kind)
    ).otherwise(F.col("__keys"))
    hashed = hashed.select(bounded.alias("__keys"))
    firsts = hashed.select(F.posexplode("__keys").alias("__i", "src"), "__keys")
    later = F.slice("__keys", F.col("__i") + F.lit(2), F.size("__keys"))
    if with_self:
        later = F.concat(F.array(F.lit(None).cast(kind.elementType)), later)
    return firsts.select("src", F.explode(later).alias("dst"))


def pair_edges(
    df: DataFrame, ids: str = "ids", key: Callable[[Column], Column] = wide_key
) -> DataFrame:
    """An edge for every pair i < j of a row's own identifiers, in array order.

    The pairs come from inside the row, so there is no self-join. Their number is
    quadratic in the length of one row's array; a row of more than MAX_IDS_PER_ROW
    identifiers fails the job.
    """
    return _pairs(_keys(df, ids, key), with_self=False)


def frequent_edges(edges: DataFrame, more_than: int = 2) -> DataFrame:
    """Edges seen more than ``more_than`` times, with their count; direction matters."""
    return (
        edges.groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > more_than)
    )


def vertices_and_edges(
    df: DataFrame,
    ids: str = "ids",
    key: Callable[[Column], Column] = wide_key,
    more_than: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Distinct vertices ``(id)`` and frequent pair edges ``(src, dst)`` in one pass.

    A vertex travels as a pair without a second end, so the source is parsed and hashed
    once and one aggregate serves both. Its tables of pairs are many times the size of what a task
    reads, so tasks are kept small. The result is stored, far smaller than the source.
    """
    counted = (
        _pairs(_keys(df, ids, key), with_self=True)
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    with small_tasks(df.sparkSession):
        kept = materialize(
            counted.where(F.col("dst").isNull() | (F.col("n") > more_than)).drop("n"), "graph"
        )
    return _split_graph(kept)


def chain_vertices_and_edges(
    df: DataFrame, fields: str = "fields", key: Callable[[Column], Column] = wide_key
) -> tuple[DataFrame, DataFrame]:
    """Distinct last vertices ``(id)`` of the rows and chain edges ``(src, dst)`` in one pass.

    The last identifier of a row travels as an edge without a second end; every other
    vertex is the end of an edge. Both results read one stored table.
    """
    hashed = _keys(df, nonblank_items(fields), key)
    links = hashed.select(F.posexplode("__keys").alias("__i", "src"), "__keys").select(
        "src", F.get("__keys", F.col("__i") + F.lit(1)).alias("dst")
    )
    with small_tasks(df.sparkSession):
        return _split_graph(materialize(links.distinct(), "graph"))


def _split_graph(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a second end are vertices, the others edges."""
    return (
        kept.where(F.col("dst").isNull() & F.col("src").isNotNull()).select(
            F.col("src").alias("id")
        ),
        kept.where(F.col("dst").isNotNull()),
    )


def chain_edges(
    df: DataFrame, fields: str = "fields", key: Callable[[Column], Column] = wide_key
) -> DataFrame:
    """Edges between neighbours of a row's fields, blanks taken out first.

    A blank would be one vertex shared by unrelated rows, so it never becomes one.
    """
    hashed = _keys(df, nonblank_items(fields), key)
    sources = F.slice("__keys", F.lit(1), F.greatest(F.size("__keys") - F.lit(1), F.lit(0)))
    return hashed.select(F.posexplode(sources).alias("__i", "src"), "__keys").select(
        "src", F.get("__keys", F.col("__i") + F.lit(1)).alias("dst")
    )


def connected_components(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Label ``(id, component)`` of every vertex: the smallest id it can reach.

    Direction is ignored, edge ends that are no listed vertex are added, and a vertex
    without edges labels itself. An edge with a null end is dropped, but its other end
    counts as a vertex. Ids may be numbers or texts.

    Large-star and small-star rounds (Kiveris et al., SoCC 2014) on edges kept as
    (child, smaller parent). Only the smallest parent per vertex is aggregated, with
    partial aggregation, so a hub is never collected; the join back to the edges treats
    hubs as hot keys. Each round is stored, which cuts the lineage. The loop ends after
    a round that changed no edge, which is exactly when the edges are stars. The labels
    are stored and everything else is deleted.
    """
    with keeping_only(edges.sparkSession) as kept:
        # With one null end both come out as the other end: a vertex of its own.
        low = F.least("src", "dst").alias("dst")
        high = F.greatest("src", "dst").alias("src")
        known = F.col("src").isNotNull() | F.col("dst").isNotNull()
        pairs = materialize(edges.where(known).select(high, low).distinct(), "components")
        links = pairs.where("src <> dst")
        stored: list[DataFrame] = []
        rows = links.count()
        changed = rows > 0
        while changed:
            large = _large_star(links, rows, rows_per_task)
            if rows > rows_per_task:
                large = materialize(large, "components")
                stored.append(large)
            following = materialize(_small_star(large, rows, rows_per_task), "components")
            rows, changed = following.agg(F.count(F.lit(1)), F.max("changed")).first()
            for table in stored:
                discard(table)
            stored = [following]
            links = following.drop("changed")

        lone = [pairs.select(F.col("dst").alias("id"))]
        if vertices is not None:
            lone.append(vertices.select("id").where(F.col("id").isNotNull()))
        labels = links.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        for ids in lone:
            labels = labels.union(ids.select("id", F.col("id").alias("component")))
        smallest = labels.groupBy("id").agg(F.min("component").alias("component"))
        kept.append(materialize(smallest, "labels"))
        return kept[0]


def _large_star(links: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """Hang every child onto the smallest parent of its parent."""
    parents = links.groupBy(F.col("src").alias("dst")).agg(F.min("dst").alias("top"))
    lifted = shuffled_lookup(links, parents, ["dst"], rows, rows_per_task)
    return lifted.select(
        "src",
        F.coalesce("top", "dst").alias("dst"),
        F.col("top").isNotNull().alias("changed"),
    )


def _small_star(links: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """Hang every vertex and its other parents onto its smallest parent."""
    parents = links.groupBy("src").agg(F.min("dst").alias("top"))
    joined = shuffled_lookup(links, parents, ["src"], rows, rows_per_task)
    differs = F.col("dst") != F.col("top")
    kept = F.struct("src", F.col("top").alias("dst"), (F.col("changed") | differs).alias("changed"))
    moved = F.struct(F.col("dst").alias("src"), F.col("top").alias("dst"), F.lit(True).alias("changed"))
    emitted = F.when(differs, F.array(kept, moved)).otherwise(F.array(kept))
    return (
        joined.select(F.inline(emitted))
        .groupBy("src", "dst")
        .agg(F.max("changed").alias("changed"))
    )
