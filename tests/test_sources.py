import os
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.errors import AnalysisException

from kinweave import operators as op
from kinweave import sources as src
from kinweave.plans.storage import checkpoint_read, checkpoint_write, discard, materialize, shared_dir


def test_text_file_and_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y\n\nz")
    (tmp_path / "in" / "b.txt").write_text("x\n")
    assert rows(src.read_text(spark, str(tmp_path / "in" / "a.txt"))) == [("",), ("x y",), ("z",)]
    assert dict(rows(op.word_count(src.read_text(spark, str(tmp_path / "in")))))["x"] == 2


def test_delimited_with_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,a\n2,b\n")
    df = src.read_delimited(spark, str(tmp_path / "a.csv"), "id int, name string", header=True)
    assert rows(df) == [(1, "a"), (2, "b")]


def test_event_log_keeps_malformed_lines(spark, tmp_path):
    (tmp_path / "log").write_text('{"user":{"uid":"u","phone":{"imei":"i"}}}\n{broken\n')
    df = src.read_event_log(spark, str(tmp_path / "log"))
    assert rows(df, "user.uid", "user.phone.imei", "_corrupt") == [
        ("u", "i", None), (None, None, "{broken"),
    ]


def test_side_table_last_line_wins_in_text_lookup(spark, tmp_path):
    (tmp_path / "names.txt").write_text("1,old\n2,two\n1,new\n")
    side = src.read_side_table(spark, str(tmp_path / "names.txt"))
    lines = spark.createDataFrame([("1,x,9",), ("2,y",), ("7,z,",)], "value string")
    out = str(tmp_path / "out")
    src.write_text(op.append_lookup_text(lines, side), out)
    assert rows(src.read_text(spark, out)) == [("1,x,9,new",), ("2,y,two",), ("7,z,,null",)]


def test_text_lookup_fails_on_a_bad_number_unless_lenient(spark, tmp_path):
    (tmp_path / "names.txt").write_text("1,one\n")
    side = src.read_side_table(spark, str(tmp_path / "names.txt"))
    lines = spark.createDataFrame([("x,1",)], "value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        op.append_lookup_text(lines, side).collect()
    assert rows(op.append_lookup_text(lines, side, strict=False)) == [("x,1,null",)]


def test_text_sink_writes_null_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, name string")
    src.write_text(df, str(tmp_path / "t"))
    assert rows(src.read_text(spark, str(tmp_path / "t"))) == [("1,null",), ("2,b",)]


def test_parquet_sink_fails_when_the_target_exists(spark, tmp_path):
    path = str(tmp_path / "dict")
    df = spark.range(4).selectExpr("id AS biaoshi_hashcode", "id AS guid")
    src.write_parquet(df.repartition(4), path, single_file=True)
    assert len(list((tmp_path / "dict").glob("part-*.parquet"))) == 1
    read = src.read_dictionary(spark, path)
    assert read.schema == src.DICTIONARY_SCHEMA and read.count() == 4
    with pytest.raises(AnalysisException):
        src.write_parquet(df, path)


def test_jdbc_options(spark):
    base = {"user": "u", "password": "p"}
    assert src.jdbc_options("jdbc:x", "t", **base)["dbtable"] == "t"
    ranged = src.jdbc_options(
        "jdbc:x", "t", **base, driver="d.D", partition_column="id", bounds=(0, 9), partitions=3
    )
    assert (ranged["partitionColumn"], ranged["lowerBound"], ranged["upperBound"]) == ("id", "0", "9")
    assert (ranged["numPartitions"], ranged["driver"]) == ("3", "d.D")
    with pytest.raises(ValueError):
        src.jdbc_options("jdbc:x", "t", **base, partitions=3)


def test_checkpoint_roundtrip_and_discard(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n int")
    checkpoint_write(df, str(tmp_path / "ck"))
    assert rows(checkpoint_read(spark, str(tmp_path / "ck"))) == [("a", 1), ("b", 2)]
    stored = materialize(df, "test")
    assert rows(stored) == rows(df)
    files = stored.inputFiles()
    discard(stored)
    with pytest.raises(AnalysisException):
        spark.read.parquet(files[0]).count()


def test_shared_folder_setting(spark):
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder)
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(session("hdfs://x/ck/", "yarn")) == "hdfs://x/ck"
    local = shared_dir(session(None, "local[2]"))
    assert os.path.isdir(local) and shared_dir(session(None, "local[2]")) == local
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(None, "yarn"))
