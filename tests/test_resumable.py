"""Merged streaks, and totals and sessions that go on from a carry, against one run over all rows."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op

BEGIN = dt.date(2024, 1, 1)


def _logins(seed, n=400, users=12, days=90):
    random.seed(seed)
    return [(random.choice([*range(users), None]), BEGIN + dt.timedelta(random.randrange(days))) for _ in range(n)]


def _blocks(edges):
    days = [BEGIN + dt.timedelta(e) for e in edges]
    return [(F.lit(a), F.lit(b - dt.timedelta(1))) for a, b in zip(days, days[1:], strict=False)]


@pytest.mark.parametrize("edges", [(0, 31, 60, 90), (0, 1, 2, 40, 90)])
def test_runs_of_blocks_merge_into_streaks(spark, edges):
    df = spark.createDataFrame(_logins(1), "user int, day date")
    want = rows(op.day_streaks(df, ["user"], "day"), "user", "days", "first_day", "last_day")
    runs = [op.block_runs(df, ["user"], "day", a, b) for a, b in _blocks(edges)]
    left = runs[0]
    for r in runs[1:]:
        left = op.merge_runs(left.unionByName(r), ["user"])
    right = runs[-1]
    for r in reversed(runs[:-1]):
        right = op.merge_runs(r.unionByName(right), ["user"])
    again = op.merge_runs(left.unionByName(runs[0]).unionByName(right), ["user"])
    for merged in (left, right, again):
        assert rows(op.merge_runs(merged, ["user"]), "user", "days", "first_day", "last_day") == want


@pytest.mark.parametrize("edges", [(0, 5, 10, 15, 60, 90)])
def test_summaries_merge_in_any_grouping(spark, edges):
    df = spark.createDataFrame(_logins(2, n=900), "user int, day date")
    runs = [(op.block_runs(df, ["user"], "day", a, b), a, b) for a, b in _blocks(edges)]
    single = [op.streak_summary(r, ["user"], a, b) for r, a, b in runs]
    union = lambda some: some[0] if len(some) == 1 else some[0].unionByName(union(some[1:]))
    whole = op.merge_summaries(union(single), ["user"])
    k = len(single) // 2 or 1
    halves = op.merge_summaries(union(single[:k]), ["user"]).unionByName(op.merge_summaries(union(single[k:]), ["user"]))
    assert rows(op.merge_summaries(halves, ["user"])) == rows(whole)
    streaks = op.day_streaks(df, ["user"], "day").groupBy("user").agg(
        F.sum("days").alias("n_days"), F.max("days").alias("longest")
    )
    assert rows(whole, "user", "n_days", "longest") == rows(streaks)


def test_a_day_without_block_breaks_a_summary(spark):
    df = spark.createDataFrame([(1, BEGIN + dt.timedelta(d)) for d in (0, 1, 3, 4)], "user int, day date")
    parts = [op.streak_summary(op.block_runs(df, ["user"], "day", a, b), ["user"], a, b)
             for a, b in [_blocks((0, 2))[0], _blocks((3, 5))[0]]]
    s = op.merge_summaries(parts[0].unionByName(parts[1]), ["user"]).first()
    assert (s.n_days, s.prefix, s.suffix, s.longest) == (4, 2, 2, 2)


ROWS = "user int, ts int, id int, v int"


def _ordered(seed, n=300):
    random.seed(seed)
    return [(random.choice([1, 1, 1, 2, 3, None]), t // 3, t, random.choice([None, 1, 5, -2])) for t in range(n)]


def _split(data, cuts):
    edges = [0, *cuts, len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@pytest.mark.parametrize("keys, slice_size", [(["user"], 1_000_000), (["user"], 30), ([], 30)])
def test_totals_in_batches_equal_one_run(spark, monkeypatch, keys, slice_size):
    if slice_size == 30:
        monkeypatch.setattr("kinweave.plans.slices.ONE_TASK_ROWS", 30)
    data = _ordered(3)
    want = rows(op.running_total(spark.createDataFrame(data, ROWS), "v", ["ts", "id"], keys), "id", "running_total")
    got, carry = [], None
    for part in _split(data, (100, 100)):
        done = op.resume_running_total(
            spark.createDataFrame(part, ROWS), carry, "v", ["ts", "id"], keys, rows_per_slice=slice_size
        )
        got, carry = got + rows(done.rows, "id", "running_total"), done.carry
    assert sorted(got, key=repr) == want
    assert carry.count() == (len({r[0] for r in data}) if keys else 1)


INTERVALS = "user int, start timestamp_ntz, end timestamp_ntz, id int, cents int"


def _intervals(n=300):
    random.seed(8)
    at, out = dt.datetime(2024, 1, 1), []
    for k in range(n):
        at += dt.timedelta(seconds=random.choice([1, 30, 400, 900]))
        out.append((random.choice([1, 1, 2, None]), at, at + dt.timedelta(seconds=random.randint(0, 500)), k, random.choice([None, 3, 10])))
    return out


@pytest.mark.parametrize("cuts", [(1, 150), (150, 150)])
def test_sessions_in_batches_equal_one_run(spark, cuts):
    data = _intervals()
    call = (["user"], "start", "end", ["start", "id"], ["cents"], 600)
    want = rows(op.gap_sessions(spark.createDataFrame(data, INTERVALS), *call))
    found, carry = {}, None
    for part in _split(data, cuts):
        done = op.resume_gap_sessions(spark.createDataFrame(part, INTERVALS), carry, *call)
        found.update({(r.user, r.session_no): tuple(r) for r in done.rows.collect()})
        carry = done.carry
    assert sorted(found.values(), key=repr) == want


def test_late_rows_fail(spark):
    first = op.resume_running_total(spark.createDataFrame([(1, 5, 0, 1)], ROWS), None, "v", ["ts"], ["user"])
    for ts in (4, 5):
        with pytest.raises(Exception, match="late row"):
            op.resume_running_total(spark.createDataFrame([(1, ts, 9, 1)], ROWS), first.carry, "v", ["ts"], ["user"])
    done = op.resume_running_total(spark.createDataFrame([(2, 4, 9, 1)], ROWS), first.carry, "v", ["ts"], ["user"])
    assert rows(done.carry, "user", "total") == [(1, 1), (2, 1)]
    data = _intervals(20)
    call = (["user"], "start", "end", ["start", "id"], ["cents"], 600)
    carry = op.resume_gap_sessions(spark.createDataFrame(data, INTERVALS), None, *call).carry
    with pytest.raises(Exception, match="late row"):
        op.resume_gap_sessions(spark.createDataFrame(data[:1], INTERVALS), carry, *call)
