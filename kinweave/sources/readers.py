"""Sources. Schemas are explicit, so no reader scans data to infer one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.scalars import comma_fields

# The fields of a log line that identify a person, in this order.
PHONE_ID_FIELDS = ["imei", "mac", "imsi", "androidId", "deviceId", "uuid"]

EVENT_LOG_SCHEMA = T.StructType(
    [
        T.StructField(
            "user",
            T.StructType(
                [
                    T.StructField("uid", T.StringType()),
                    T.StructField(
                        "phone",
                        T.StructType([T.StructField(f, T.StringType()) for f in PHONE_ID_FIELDS]),
                    ),
                ]
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)

# The columns of the stored id dictionary.
DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("biaoshi_hashcode", T.LongType()),
        T.StructField("guid", T.LongType()),
    ]
)


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of a file, folder or glob as column ``value``."""
    return spark.read.text(path)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    header: bool = False,
    separator: str = ",",
) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, sep=separator)


def parse_event_log(lines: Column) -> Column:
    """A log line as a struct; a line that is not JSON keeps its text in ``_corrupt``."""
    return F.from_json(
        lines,
        EVENT_LOG_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )


def read_event_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON log lines parsed into ``user`` and ``_corrupt``."""
    return read_text(spark, path).select(parse_event_log(F.col("value")).alias("log")).select("log.*")


def read_parquet(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The stored id dictionary: identifier key and person id."""
    return read_parquet(spark, path, DICTIONARY_SCHEMA)


def read_side_table(spark: SparkSession, path: str) -> DataFrame:
    """A small ``id,name`` file with the line order that decides between equal ids.

    A line whose id is not a number fails the job.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_order"),
    )
    fields = comma_fields("value")
    return lines.select(
        fields[0].cast("int").alias("id"), fields[1].alias("name"), F.col("line_order")
    )


def jdbc_options(
    url: str,
    table: str,
    user: str,
    password: str,
    driver: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC scan; with a partition column the table is read in parallel."""
    options = {
        "url": url,
        "dbtable": table,
        "user": user,
        "password": password,
        "fetchsize": str(fetch_size),
    }
    if driver:
        options["driver"] = driver
    ranged = (partition_column, bounds, partitions)
    if any(x is not None for x in ranged):
        if any(x is None for x in ranged):
            raise ValueError("give partition_column, bounds and partitions together")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **settings) -> DataFrame:
    """A database table; credentials come from the caller (see ``jdbc_options``)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **settings)).load()


def sequence(spark: SparkSession, values: Sequence[int], name: str = "id") -> DataFrame:
    """A literal sequence of numbers as one column."""
    schema = T.StructType([T.StructField(name, T.IntegerType())])
    return spark.createDataFrame([(v,) for v in values], schema)
