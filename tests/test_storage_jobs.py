"""Log intake, bucketed dictionaries, files by size and filters before a shuffle."""

import json
import random
import re
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave import sources as src
from kinweave.plans import bloom
from kinweave.plans.bloom import bloom_prune, bloom_rows, pruned_lookup
from kinweave.sources import sized
from kinweave.streaming import intake, read_corrupt_lines, read_intake, take_in_logs


def _line(k):
    return json.dumps({"user": {"uid": f"u{k}", "phone": {"imei": f"i{k}"}}})


def _drop(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def folders(tmp_path):
    return tmp_path / "logs", str(tmp_path / "target"), str(tmp_path / "state")


def _ids(spark, target):
    return sorted(r.ids[0] for r in read_intake(spark, target).collect())


def test_every_file_is_taken_in_once(spark, folders):
    logs, target, state = folders
    _drop(logs, "a", [_line(1), "{torn", _line(2)])
    assert take_in_logs(spark, str(logs), target, state) == 3
    _drop(logs, "b", [_line(3)])
    _drop(logs, "c", ["also torn", _line(4)])
    assert take_in_logs(spark, str(logs), target, state, files_per_batch=1) == 3
    assert take_in_logs(spark, str(logs), target, state) == 0
    assert _ids(spark, target) == ["u1", "u2", "u3", "u4"]
    assert rows(read_corrupt_lines(spark, target)) == [("a", "{torn"), ("c", "also torn")]
    people = op.id_mapping([read_intake(spark, target)], more_than=0, key=lambda c: c)
    assert people.select("guid").distinct().count() == 4


def test_a_run_that_died_is_repeated_without_loss_or_repeats(spark, folders, monkeypatch):
    logs, target, state = folders
    _drop(logs, "a", [_line(k) for k in range(5)])
    take_in_logs(spark, str(logs), target, state)
    _drop(logs, "b", [_line(k) for k in range(5, 9)])
    whole = intake.extract_ids

    def dies(lines):
        bad = F.when(F.col("value").contains("u8"), F.raise_error(F.lit("dead"))).otherwise(F.col("value"))
        return whole(lines.withColumn("value", bad))

    monkeypatch.setattr(intake, "extract_ids", dies)
    with pytest.raises(Exception, match="dead"):
        take_in_logs(spark, str(logs), target, state)
    assert _ids(spark, target) == [f"u{k}" for k in range(5)]
    monkeypatch.setattr(intake, "extract_ids", whole)
    _drop(logs, "c", [_line(9)])
    take_in_logs(spark, str(logs), target, state)
    assert _ids(spark, target) == [f"u{k}" for k in range(10)]


def test_a_commit_that_was_lost_doubles_nothing(spark, folders):
    logs, target, state = folders
    _drop(logs, "a", [_line(k) for k in range(5)])
    take_in_logs(spark, str(logs), target, state)
    commits = sorted((folders[0].parent / "state" / "commits").glob("[0-9]*"))
    for f in [commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:
        f.unlink(missing_ok=True)
    take_in_logs(spark, str(logs), target, state)
    assert _ids(spark, target) == [f"u{k}" for k in range(5)]


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    return re.findall(r"Exchange hashpartitioning\((\w+)#", plan), plan


def test_a_bucketed_dictionary_is_not_shuffled(spark, tmp_path):
    table, path = f"d{uuid.uuid4().hex}", str(tmp_path / "d")
    data = [(k, f"g{k % 7}") for k in range(500)]
    source = spark.createDataFrame(data, "id bigint, guid string").repartition(5)
    today = spark.range(0, 1000, 3).repartition(4)
    dictionary = src.write_bucketed(source, table, path, "id", 16)
    joined = src.bucketed_lookup(today, dictionary, "id")
    exchanges, plan = _exchanges(joined)
    assert len(exchanges) == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert len(_exchanges(today.join(source.hint("merge"), "id", "left"))[0]) == 2
    assert rows(joined) == rows(today.join(source, "id", "left"))
    assert len(list((tmp_path / "d").glob("*.parquet"))) <= 16
    again = src.open_bucketed(spark, f"{table}_again", path, "id bigint, guid string", "id", 16)
    assert len(_exchanges(src.bucketed_lookup(today, again, "id"))[0]) == 1
    assert rows(src.bucketed_lookup(today, again, "id")) == rows(joined)
    for t in (table, f"{table}_again"):
        spark.sql(f"DROP TABLE {t}")


def test_packing_bounds():
    random.seed(6)
    for _ in range(200):
        sizes = {f"f{k}": int(random.choice([3, 50, 900, 10**5]) * (1 + random.random())) for k in range(random.randint(1, 80))}
        packing = sized.pack(sizes, 1000)
        load = [0.0] * packing.bins
        for f, bins in packing.of_file.items():
            for b in bins:
                load[b] += sizes[f] / len(bins)
        assert abs(sum(load) - sum(sizes.values())) < 1
        if sum(sizes.values()) > 700:
            assert 400 <= min(load) and max(load) <= 1750


@pytest.mark.parametrize("tasks", [1, 60])
def test_files_of_about_the_target(spark, tmp_path, tasks):
    df = spark.range(120_000, numPartitions=tasks).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    path, target = str(tmp_path / "out"), 400_000
    src.write_sized(df, path, target)
    sizes = sized.file_sizes(spark, path)
    assert len(sizes) > 5 and all(target / 2 <= s <= 2 * target for s in sizes.values())
    back = spark.read.parquet(path)
    assert back.count() == 120_000 and back.exceptAll(df).count() == 0


def test_small_and_empty_results_are_one_file(spark, tmp_path):
    for name, df in (("few", spark.range(3, numPartitions=3)), ("none", spark.range(0))):
        src.write_sized(df, str(tmp_path / name))
        assert len(sized.file_sizes(spark, str(tmp_path / name))) == 1
        assert rows(spark.read.parquet(str(tmp_path / name))) == rows(df)


def test_a_filter_drops_rows_without_a_partner_only(spark):
    big = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 3).alias("m"), "id")
    small = big.where("id % 50 = 0").select("k", "m", (F.col("id") * 2).alias("v"))
    bits, blocks = bloom_rows(small, ["k", "m"], small.count())
    left = bloom_prune(big, bits, blocks, ["k", "m"])
    assert left.columns == big.columns
    n = left.count()
    assert 1000 <= n < 2500 and left.join(small, ["k", "m"]).count() == 1000


@pytest.mark.parametrize("max_rows", [None, 10])
def test_pruned_lookup_equals_the_join(spark, monkeypatch, max_rows):
    random.seed(3)
    big = spark.createDataFrame([(random.choice([1, 1, 5, 9, None, *range(2000)]), k) for k in range(5000)], "a int, n int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 2500, 10)] + [(1, "one")], "a int, v string")
    want = rows(big.join(small, "a"))
    assert rows(pruned_lookup(big, small, ["a"], max_rows=max_rows, rows_per_task=200)) == want
    monkeypatch.setattr(bloom, "MAX_ROWS", 1)
    assert rows(pruned_lookup(big, small, ["a"], max_rows=max_rows)) == want
    assert pruned_lookup(big, small.limit(0), ["a"], max_rows=0).count() == 0
