"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave import sources as src
from kinweave.functions import (
    compare_to_range,
    contains_literal,
    java_hash,
    tokens,
    url_host,
)
from kinweave.operators.relational import explode_items
from kinweave.plans.bloom import pruned_lookup as bloom_pruned_lookup
from kinweave.plans.storage import checkpoint_read, checkpoint_write, materialize, scratch_path
from kinweave.streaming import read_corrupt_lines, read_intake, take_in_logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIX_HOURS = 6 * 3600
SPLIT_DATE = "1998-04-25"
THIRD_DATE = "1998-06-10"


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return src.read_parquet(spark, f"{sf_dir}/{name}.parquet")


# Words, sums, filters, unions


@_query
def word_count(spark, sf_dir):
    return op.word_count(_table(spark, sf_dir, "documents"), "text")


@_query
def word_count_text(spark, sf_dir):
    """The same over text files, line by line."""
    path = scratch_path(spark, "documents_text")
    src.write_text(_table(spark, sf_dir, "documents"), path, columns=["text"])
    return op.word_count(src.read_text(spark, path))


@_query
def checkpoint_reload(spark, sf_dir):
    path = scratch_path(spark, "word_count")
    checkpoint_write(op.word_count(_table(spark, sf_dir, "documents"), "text"), path)
    return checkpoint_read(spark, path)


@_query
def write_sized_files(spark, sf_dir):
    """Word counts written by all tasks, packed into files of 256 KB and read back."""
    path = scratch_path(spark, "sized")
    src.write_sized(op.word_count(_table(spark, sf_dir, "documents"), "text"), path, 256 * 1024)
    return src.read_parquet(spark, path)


@_query
def write_single_file(spark, sf_dir):
    path = scratch_path(spark, "single")
    counts = op.word_count(_table(spark, sf_dir, "documents").select(F.col("source").alias("text")), "text")
    src.write_parquet(counts, path, single_file=True)
    files = src.read_parquet(spark, path).select("word", "n", F.col("_metadata.file_name").alias("file"))
    one_file = files.groupBy().agg(F.countDistinct("file").alias("n_files"))
    return files.drop("file").crossJoin(F.broadcast(one_file))


@_query
def sequence_lookup(spark, sf_dir):
    """Customers of every nation key from 0 to 29, also of those that no nation has."""
    keys = src.sequence(spark, range(30), "c_nationkey")
    customers = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(customers, "c_nationkey", "left").select(
        "c_nationkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


@_query
def sum_by_key(spark, sf_dir):
    soldiers = op.typed_projection(
        _table(spark, sf_dir, "customer"),
        {
            "id": ("c_custkey", "bigint"),
            "name": ("c_name", "string"),
            "role": ("c_mktsegment", "string"),
            "fight": ("c_acctbal", "double"),
        },
    )
    return op.sum_by_key(soldiers, "role", "fight").withColumn("total", F.round("total", 2))


@_query
def conjunctive_filter(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return op.conjunctive_filter(lines, "l_linenumber < 4", "l_linenumber < 3")


@_query
def union_logs(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")

    def log(source: str, *types: str) -> DataFrame:
        return events.where(F.col("event_type").isin(*types)).withColumn("source", F.lit(source))

    return op.union_logs(
        log("app", "click", "view"), log("web", "purchase", "error"), log("mini", "signup", "view")
    )


# Scalar functions


@_query
def url_domain(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", url_host("url").alias("host"))


@_query
def array_contains_literal(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("words"))
    return words.select(
        "doc_id",
        contains_literal("words", "").cast("int").alias("has_empty"),
        contains_literal("words", r"\s+").cast("int").alias("has_pattern_text"),
        contains_literal("words", "the").cast("int").alias("has_the"),
    )


@_query
def range_compare(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    side = compare_to_range("value", F.lit(5.0), F.lit(20.0))
    return events.select("event_id", side.alias("side"))


# Lookups


def _nation_names(spark, sf_dir) -> DataFrame:
    """Names of the nations of three regions, each after an older line that must lose."""
    nation = _table(spark, sf_dir, "nation").where("n_regionkey < 3")
    old_name = F.concat(F.lit("OLD_"), "n_name").alias("n_name")
    old = nation.select("n_nationkey", old_name, F.lit(1).alias("line"))
    new = nation.select("n_nationkey", "n_name", F.lit(2).alias("line"))
    return old.unionByName(new)


@_query
def broadcast_lookup_join(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")
    )
    return op.keyed_lookup(customers, _nation_names(spark, sf_dir), "n_nationkey", "n_name", "line")


@_query
def lookup_text_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "customer").select(
        F.concat_ws(",", "c_nationkey", "c_name", "c_mktsegment").alias("value")
    )
    side = _nation_names(spark, sf_dir).toDF("id", "name", "line_order")
    path = scratch_path(spark, "lookup_text")
    src.write_text(op.append_lookup_text(lines, side), path)
    return src.read_text(spark, path)


@_query
def side_table_lookup(spark, sf_dir):
    """The side table comes from a file of id,name lines, of which the last one of an id wins."""
    lines = _nation_names(spark, sf_dir).orderBy("line").select(
        F.concat_ws(",", "n_nationkey", "n_name").alias("value")
    )
    path = scratch_path(spark, "side_table")
    src.write_text(lines.coalesce(1), path)
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    return op.keyed_lookup(customers, src.read_side_table(spark, path), "id", "name", "line_order")


@_query
def pruned_lookup(spark, sf_dir):
    """Lines of one customer segment: a filter of its orders drops the others before the shuffle."""
    buyers = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")
    )
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return bloom_pruned_lookup(lines, orders.join(buyers, "c_custkey"), ["l_orderkey"], max_rows=100)


@_query
def range_lookup_mixed_types(spark, sf_dir):
    """A double against whole-numbered ends, which are compared as doubles."""
    events = _table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"))
    key = F.col("n_nationkey").cast("bigint")
    bands = _table(spark, sf_dir, "nation").select(
        (key * 4).alias("start"), (key * 4 + 2).alias("end"), F.col("n_name").alias("band")
    )
    args = (events, bands, "x", "start", "end", ["band"])
    ways = {"between": op.range_lookup, "search": op.range_lookup_asof, "merged": op.range_lookup_merged}
    found = [way(*args).withColumn("way", F.lit(name)) for name, way in ways.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _event_cents(spark, sf_dir) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return _table(spark, sf_dir, "events").select("event_id", cents.alias("cents"))


@_query
def range_lookup(spark, sf_dir):
    key = F.col("n_nationkey").cast("bigint")
    bands = _table(spark, sf_dir, "nation").select(
        (key * 400).alias("start"), (key * 400 + 250).alias("end"), F.col("n_name").alias("band")
    )
    return op.range_lookup(_event_cents(spark, sf_dir), bands, "cents", "start", "end", ["band"])


def _part_bands(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        (F.col("p_partkey") * 3).alias("start"),
        (F.col("p_partkey") * 3 + 1).alias("end"),
        F.col("p_name").alias("band"),
    )


@_query
def range_lookup_asof(spark, sf_dir):
    events, bands = _event_cents(spark, sf_dir), _part_bands(spark, sf_dir)
    return op.range_lookup_asof(events, bands, "cents", "start", "end", ["band"])


@_query
def range_lookup_merged(spark, sf_dir):
    events, bands = _event_cents(spark, sf_dir), _part_bands(spark, sf_dir)
    return op.range_lookup_merged(events, bands, "cents", "start", "end", ["band"])


@_query
def position_lookup(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    sizes = parts.where("p_brand = 'Brand#1'").select("p_size")
    return op.position_lookup(parts.select("p_partkey", "p_size"), sizes, "p_size")


# Windows


@_query
def login_streaks(spark, sf_dir):
    streaks = op.day_streaks(_table(spark, sf_dir, "events"), ["user_id"], "ts")
    return streaks.select(
        "user_id",
        "days",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
    )


EVENT_WEEKS = 6


def _weeks(spark, sf_dir) -> list[tuple[Column, Column]]:
    """The weeks from the first event on; a week past the last event is an empty block."""
    begin = _table(spark, sf_dir, "events").agg(F.to_date(F.min("ts"))).first()[0]
    days = [F.date_add(F.lit(begin), 7 * k) for k in range(EVENT_WEEKS)]
    return [(day, F.date_add(day, 6)) for day in days]


@_query
def login_streaks_merged(spark, sf_dir):
    """The streaks of each week by itself, merged week by week."""
    events, merged = _table(spark, sf_dir, "events"), None
    for first, last in _weeks(spark, sf_dir):
        runs = op.block_runs(events, ["user_id"], "ts", first, last)
        merged = runs if merged is None else op.merge_runs(merged.unionByName(runs), ["user_id"])
    return merged.select(
        "user_id",
        "days",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
    )


@_query
def longest_streaks_merged(spark, sf_dir):
    """Active days and longest streak per user out of one summary per week."""
    events, summaries = _table(spark, sf_dir, "events"), None
    for first, last in _weeks(spark, sf_dir):
        runs = op.block_runs(events, ["user_id"], "ts", first, last)
        week = op.streak_summary(runs, ["user_id"], first, last)
        summaries = week if summaries is None else summaries.unionByName(week)
    return op.merge_summaries(summaries, ["user_id"]).select("user_id", "n_days", "longest")


@_query
def running_total(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    totals = op.running_total(events, "event_id", ["ts", "event_id"], ["user_id"])
    return totals.select("event_id", "user_id", "running_total")


def _event_batches(events: DataFrame, at: str) -> list[DataFrame]:
    """The events up to the tenth and the twentieth of the month, and the others."""
    cuts = [F.lit(f"2024-01-{d} 06:00:00").cast("timestamp_ntz") for d in (10, 20)]
    time = F.col(at)
    return [events.where(time < cuts[0]), events.where((time >= cuts[0]) & (time < cuts[1])), events.where(time >= cuts[1])]


@_query
def running_total_resumed(spark, sf_dir):
    """Three batches of events, each going on from the totals stored before."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    parts, carry = [], None
    for batch in _event_batches(events, "ts"):
        done = op.resume_running_total(batch, carry, "event_id", ["ts", "event_id"], ["user_id"])
        parts, carry = [*parts, done.rows], done.carry
    return op.union_logs(*parts).select("event_id", "user_id", "running_total")


@_query
def running_total_global(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return op.running_total(orders, "o_custkey", ["o_orderkey"])


def _event_intervals(spark, sf_dir) -> DataFrame:
    length = F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))
    return _table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").alias("start"),
        (F.col("ts") + length).alias("end"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


@_query
def within_gap(spark, sf_dir):
    rows = op.within_gap(
        _event_intervals(spark, sf_dir).drop("cents"),
        ["user_id"],
        "start",
        "end",
        ["start", "event_id"],
        SIX_HOURS,
    )
    return rows.select("event_id", "user_id", F.col("within_gap").cast("int").alias("within_gap"))


@_query
def gap_sessions(spark, sf_dir):
    sessions = op.gap_sessions(
        _event_intervals(spark, sf_dir),
        ["user_id"],
        "start",
        "end",
        ["start", "event_id"],
        ["cents"],
        SIX_HOURS,
    )
    stamp = "yyyy-MM-dd HH:mm:ss"
    return sessions.select(
        "user_id",
        "session_no",
        F.date_format("session_start", stamp).alias("session_start"),
        F.date_format("session_end", stamp).alias("session_end"),
        "n_rows",
        "cents",
    )


@_query
def gap_sessions_resumed(spark, sf_dir):
    """The same in three batches; a session that went on replaces its earlier row."""
    versions, carry = [], None
    for number, batch in enumerate(_event_batches(_event_intervals(spark, sf_dir), "start")):
        done = op.resume_gap_sessions(
            batch, carry, ["user_id"], "start", "end", ["start", "event_id"], ["cents"], SIX_HOURS
        )
        versions, carry = [*versions, done.rows.withColumn("batch", F.lit(number))], done.carry
    stamp = "yyyy-MM-dd HH:mm:ss"
    latest = op.union_logs(*versions).groupBy("user_id", "session_no").agg(
        F.max_by(F.struct("session_start", "session_end", "n_rows", "cents"), "batch").alias("s")
    )
    return latest.select(
        "user_id",
        "session_no",
        F.date_format("s.session_start", stamp).alias("session_start"),
        F.date_format("s.session_end", stamp).alias("session_end"),
        "s.n_rows",
        "s.cents",
    )


# Bitmaps


def _customer_bitmaps(spark, sf_dir) -> DataFrame:
    """Bitmaps of the ordering customers per nation and region."""
    # Repeats go before the join, so a customer with many orders is one row in it.
    buyers = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = (
        _table(spark, sf_dir, "nation")
        .withColumnRenamed("n_nationkey", "c_nationkey")
        .join(
            _table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
            "n_regionkey",
        )
        .select("c_nationkey", "n_name", "r_name")
    )
    located = buyers.join(customers, "c_custkey").join(places, "c_nationkey")
    return op.bitmap_build(located, ["n_name", "r_name"], "c_custkey")


@_query
def bitmap_distinct(spark, sf_dir):
    return op.bitmap_cardinality(_customer_bitmaps(spark, sf_dir), ["n_name"])


@_query
def bitmap_rollup(spark, sf_dir):
    regions = op.bitmap_merge(_customer_bitmaps(spark, sf_dir), ["r_name"])
    return op.bitmap_cardinality(regions, ["r_name"])


@_query
def bitmap_distinct_strings(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")
    bitmaps = op.bitmap_build_strings(customers, ["c_mktsegment"], "c_name")
    return op.bitmap_cardinality(bitmaps, ["c_mktsegment"])


@_query
def bitmap_distinct_exact(spark, sf_dir):
    """Different words per language, by numbers that two batches of documents gave them."""
    docs = _table(spark, sf_dir, "documents")
    words = materialize(explode_items(docs, tokens("text"), "word", "doc_id", "lang"), "words")
    path = scratch_path(spark, "string_ids")
    op.grow_string_ids(spark, path, "even", words.where(F.col("doc_id") % 2 == 0), "word")
    ids = op.grow_string_ids(spark, path, "all", words, "word")
    bitmaps = op.bitmap_build_exact(words, ["lang"], "word", ids)
    return op.bitmap_cardinality(bitmaps, ["lang"])


@_query
def container_rollup(spark, sf_dir):
    """Orders per line status, out of containers per flag: sparse ones for parts, dense for orders."""
    lines = _table(spark, sf_dir, "lineitem")
    found = []
    for what in ("l_orderkey", "l_suppkey"):
        built = op.container_build(lines, ["l_linestatus", "l_returnflag", "l_linenumber"], what)
        fine = materialize(built, "containers")
        coarse = op.container_merge(fine, ["l_linestatus"])
        counts = op.container_cardinality(coarse, ["l_linestatus"])
        found.append(counts.withColumn("what", F.lit(what)))
    return found[0].unionByName(found[1])


# Identity mapping


def _prefixed(letter: str, number: str) -> Column:
    return F.concat(F.lit(letter), F.col(number).cast("string"))


def _order_lines(spark, sf_dir) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_returnflag",
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, "o_orderkey")


def _log_lines(order_lines: DataFrame) -> DataFrame:
    """Order lines as JSON log lines, some of whose fields are blank or absent."""
    blank = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, " \t")
    phone = F.struct(
        _prefixed("s", "l_suppkey").alias("imei"),
        blank.alias("mac"),
        F.when(F.col("l_linenumber") != 3, _prefixed("p", "l_partkey")).alias("deviceId"),
    )
    user = F.struct(_prefixed("c", "o_custkey").alias("uid"), phone.alias("phone"))
    return order_lines.select(
        "o_orderkey", "l_linenumber", F.to_json(F.struct(user.alias("user"))).alias("value")
    )


def _logs(order_lines: DataFrame) -> list[DataFrame]:
    """Three logs with extracted ids, one per return flag."""
    return [
        op.extract_ids(_log_lines(order_lines.where(F.col("l_returnflag") == flag)))
        for flag in ("A", "N", "R")
    ]


@_query
def extract_ids(spark, sf_dir):
    rows = op.extract_ids(_log_lines(_order_lines(spark, sf_dir)))
    return rows.select(
        "o_orderkey", "l_linenumber", F.array_join("ids", "|").alias("ids")
    )


def _id_arrays(spark, sf_dir) -> DataFrame:
    ids = F.array(
        _prefixed("c", "o_custkey"), _prefixed("s", "l_suppkey"), _prefixed("p", "l_partkey")
    )
    return _order_lines(spark, sf_dir).select(ids.alias("ids"))


@_query
def id_vertices(spark, sf_dir):
    vertices = op.id_vertices(_id_arrays(spark, sf_dir), key=java_hash)
    return vertices.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))


@_query
def id_edges(spark, sf_dir):
    return op.frequent_edges(op.pair_edges(_id_arrays(spark, sf_dir), key=java_hash))


@_query
def chain_edges(spark, sf_dir):
    rows = _order_lines(spark, sf_dir).select(
        F.array(
            _prefixed("c", "o_custkey"),
            F.when(F.col("l_linenumber") > 1, _prefixed("s", "l_suppkey")).otherwise(" "),
            _prefixed("p", "l_partkey"),
        ).alias("fields")
    )
    edges = op.chain_edges(rows, key=java_hash)
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@_query
def connected_components(spark, sf_dir):
    pairs = _order_lines(spark, sf_dir).select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")
    )
    return op.connected_components(op.frequent_edges(pairs))


@_query
def connected_components_all(spark, sf_dir):
    """Every customer-supplier pair: one dense component with hubs."""
    pairs = _order_lines(spark, sf_dir).select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")
    )
    return op.connected_components(pairs)


@_query
def connected_components_deep(spark, sf_dir):
    """Paths of 64 orders, every seventh path tied to a hub, and edges with a null end."""
    key = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    paths = orders.where(key % 64 != 0).select(key.alias("src"), (key - 1).alias("dst"))
    hub = orders.where(key % 448 == 0).select(key.alias("src"), F.lit(-1).cast("bigint").alias("dst"))
    loose = orders.where(key % 1000 == 1).select(
        F.lit(None).cast("bigint").alias("src"), (-key - 1).alias("dst")
    )
    return op.connected_components(paths.unionByName(hub).unionByName(loose))


@_query
def id_mapping(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    src.write_parquet(op.id_mapping(_logs(_order_lines(spark, sf_dir)), key=java_hash), path)
    return src.read_dictionary(spark, path)


@_query
def id_mapping_exact(spark, sf_dir):
    """The identifiers themselves as keys, so that no two people can share one."""
    return op.id_mapping(_logs(_order_lines(spark, sf_dir)), key=lambda c: c)


@_query
def id_mapping_rolling(spark, sf_dir):
    lines = _order_lines(spark, sf_dir)
    first = lines.where(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    second = lines.where(F.col("o_orderdate") >= F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    path = scratch_path(spark, "dictionary")
    src.write_parquet(op.id_mapping(_logs(first), key=java_hash), path)
    return op.id_mapping_rolling(
        _logs(second), src.read_dictionary(spark, path), key=java_hash
    )


@_query
def id_mapping_incremental(spark, sf_dir):
    """Three days: the second and third change the first one's dictionary by their deltas."""
    lines, day = _order_lines(spark, sf_dir), F.col("o_orderdate")
    second, third = (F.lit(d).cast("timestamp_ntz") for d in (SPLIT_DATE, THIRD_DATE))
    dictionary = op.id_mapping(_logs(lines.where(day < second)), key=java_hash)
    for logs in (_logs(lines.where((day >= second) & (day < third))), _logs(lines.where(day >= third))):
        dictionary = op.id_mapping_incremental(logs, dictionary, key=java_hash)
    return dictionary


@_query
def id_mapping_log_files(spark, sf_dir):
    """Log files on the default key; keys are hashes, so people are told by their identifiers."""
    lines = _order_lines(spark, sf_dir)
    logs = []
    for flag in ("A", "N", "R"):
        path = scratch_path(spark, "event_log")
        src.write_text(_log_lines(lines.where(F.col("l_returnflag") == flag)), path, columns=["value"])
        # Two operators read the identifiers: a line is parsed for both at once.
        logs.append(materialize(op.event_ids(src.read_event_log(spark, path)).select("ids"), "log_ids"))
    people = op.id_mapping(logs).withColumnRenamed("biaoshi_hashcode", "id")
    names = op.union_logs(*[op.id_vertices(log) for log in logs]).distinct()
    return (
        names.join(people, "id")
        .groupBy("guid")
        .agg(F.min("value").alias("first_id"), F.count(F.lit(1)).alias("n_ids"))
        .drop("guid")
    )


@_query
def log_intake(spark, sf_dir):
    """Two drops of log files, each taken in by its own run; every 50th line is cut short."""
    lines = _log_lines(_order_lines(spark, sf_dir))
    torn = F.when(F.col("o_orderkey") % 50 == 0, F.substring("value", 1, 25)).otherwise(F.col("value"))
    lines = lines.withColumn("value", torn)
    source, target, checkpoint = (scratch_path(spark, f"intake_{x}") for x in ("source", "target", "state"))
    for drop in (F.col("l_linenumber") <= 3, F.col("l_linenumber") > 3):
        src.write_text(lines.where(drop), source, columns=["value"], mode="append")
        take_in_logs(spark, source, target, checkpoint)
    events = read_intake(spark, target).select(F.array_join("ids", "|").alias("text"), F.lit("ids").alias("kind"))
    corrupt = read_corrupt_lines(spark, target).select(F.col("line").alias("text"), F.lit("line").alias("kind"))
    return events.unionByName(corrupt).groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"))


@_query
def bucketed_dictionary(spark, sf_dir):
    """The second day's identifiers looked up in the first day's dictionary, stored in buckets."""
    lines, cut = _order_lines(spark, sf_dir), F.lit(SPLIT_DATE).cast("timestamp_ntz")
    path = scratch_path(spark, "bucketed")
    table = "kinweave_" + path.rsplit("-", 1)[1]
    first = op.id_mapping(_logs(lines.where(F.col("o_orderdate") < cut)), key=java_hash)
    dictionary = src.write_bucketed(first, table, path, "biaoshi_hashcode", 16)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the plan knows their buckets
    today = op.union_logs(*[op.id_vertices(x, key=java_hash) for x in _logs(lines.where(F.col("o_orderdate") >= cut))])
    ids = today.select(F.col("id").alias("biaoshi_hashcode"), "value").distinct()
    return src.bucketed_lookup(ids, dictionary, "biaoshi_hashcode")


def _rare_ids(spark, sf_dir) -> DataFrame:
    """Three identifiers that many lines share, and four that hardly any two lines do."""
    ids = F.array(
        _prefixed("c", "o_custkey"),
        _prefixed("s", "l_suppkey"),
        _prefixed("p", "l_partkey"),
        _prefixed("o", "o_orderkey"),
        F.concat(_prefixed("m", "o_orderkey"), _prefixed("-", "l_linenumber")),
        F.concat(_prefixed("i", "l_partkey"), _prefixed("-", "l_suppkey"), _prefixed("-", "o_custkey")),
        F.concat(_prefixed("u", "o_custkey"), _prefixed("-", "l_partkey")),
    )
    return _order_lines(spark, sf_dir).select(ids.alias("ids"))


@_query
def id_edges_pruned(spark, sf_dir):
    return op.frequent_pairs(_rare_ids(spark, sf_dir), key=lambda c: c)


@_query
def tag_rows_with_guid(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.concat_ws("-", F.lit("group"), "c_nationkey", "c_mktsegment").alias("place"),
        F.col("c_custkey").alias("amount"),
    )
    suppliers = _table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.concat_ws("-", F.lit("group"), "s_nationkey", F.lit("BUILDING")).alias("place"),
        F.col("s_suppkey").alias("amount"),
    )
    rows = customers.unionByName(suppliers)
    lines = rows.select(F.concat_ws(",", "name", "place", "amount").alias("value"))
    return op.tag_rows_with_guid(lines, id_fields=[0, 1], key=java_hash)
