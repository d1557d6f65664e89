from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave import sources as src


def test_word_count(spark):
    lines = [
        "red fish blue fish",
        " leading blank",
        "two  blanks\tand a tab ",
        "",
        "   ",
        "fish\x0bred",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = dict(rows(op.word_count(df)))
    assert got == {
        "red": 2, "fish": 3, "blue": 1, "leading": 1, "blank": 1, "two": 1, "blanks": 1,
        "and": 1, "a": 1, "tab": 1, "": 2,
    }


def test_conjunctive_filter_on_a_literal_sequence(spark):
    df = src.sequence(spark, [1, 2, 3, 4, 5])
    assert rows(op.conjunctive_filter(df, "id < 4", "id < 3")) == [(1,), (2,)]


def test_sum_by_key_of_a_typed_projection(spark):
    df = spark.createDataFrame(
        [("1", "a", "mage", 1.5), ("2", "b", "mage", 2.0), ("3", "c", "tank", 4.0)],
        "id string, name string, role string, battel double",
    )
    soldiers = op.typed_projection(
        df, {"id": ("id", "int"), "role": ("role", "string"), "fight": ("battel", "double")}
    )
    assert soldiers.dtypes == [("id", "int"), ("role", "string"), ("fight", "double")]
    assert rows(op.sum_by_key(soldiers, "role", "fight")) == [("mage", 3.5), ("tank", 4.0)]


def test_union_matches_by_name_and_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = a.select("s", "id")
    c = a.withColumn("s", F.lit("y"))
    assert rows(op.union_logs(a, b, c), "id", "s") == [(1, "x"), (1, "x"), (1, "y")]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = op.conjunctive_filter(spark.read.parquet(str(tmp_path / "t")), "id < 4", "id < 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,4)" in plan and "LessThan(id,3)" in plan


def test_a_text_is_split_once_for_its_words(spark):
    df = spark.createDataFrame([("a b a",), ("",), (" ",), (None,)], "value string")
    plan = op.word_count(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert rows(op.word_count(df)) == [("", 1), ("a", 2), ("b", 1)]
