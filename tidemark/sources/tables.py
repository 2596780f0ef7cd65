"""Readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that executors share; of this machine only where the session names none and runs
    on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: computed once, whatever reads it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_contract(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The required columns of a Parquet dataset; an error that lists those it lacks."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.select(*required)


def read_csv_series(spark: SparkSession, paths: list[str], schema: str, columns: list[str], tag: str = "fold") -> DataFrame:
    """Listed columns of CSV files with UTC times, tagged by the name of file or folder; the first row of a timestamp."""
    from tidemark.operators.timeseries import dedupe

    rows = spark.read.schema(schema).option("header", True).csv(paths).withColumn(tag, F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:/[^/]*)?$", 1))
    return dedupe(rows.select(*columns, tag), ["timestamp_utc", tag], [F.col(c) for c in columns if c != "timestamp_utc"])


def read_jsonl_log(spark: SparkSession, path: str, schema: str, data_type: str) -> DataFrame:
    return spark.read.schema(schema).json(path).where(F.col("data_type") == data_type)


def write_overwrite(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_series(df: DataFrame, table: str, by: str = "series_id", order: str = "timestamp_utc", part: str | None = None, buckets: int = 64) -> None:
    """Write a new catalog table of ``buckets`` buckets by series, each file sorted by series and time, in folders by ``part`` (a
    column: a year, say). Windows and joins by series on it need no exchange. Its files lie in the shared folder."""
    rows = df.repartition(buckets, by)  # a file a bucket and folder, not one for each task
    writer = rows.write.mode("errorifexists").format("parquet").option("path", scratch(df.sparkSession)).bucketBy(buckets, by).sortBy(by, order)
    (writer.partitionBy(part) if part else writer).saveAsTable(table)


def replace_parts(df: DataFrame, table: str) -> None:
    """Replace those folders of a table of write_series() that ``df`` has rows of, and no others."""
    spark, key = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    old = spark.conf.get(key, "static")
    spark.conf.set(key, "dynamic")
    try:
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, old)


def write_version(df: DataFrame, path: str) -> None:
    """Write once; an existing version is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def write_csv_table(df: DataFrame, path: str, order: list[str], decimals: int = 9) -> None:
    """A small result table as one CSV file in a fixed order with fixed decimals."""
    cols = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_ingestion_log(df: DataFrame, chunk: str, path: str) -> None:
    """One row for each source chunk with its number of rows, in place of an earlier log."""
    df.groupBy(chunk).agg(F.count("*").alias("raw_row_count")).write.mode("overwrite").json(path)


def write_manifest(df: DataFrame, parameters: dict[str, str], path: str, ts: str = "timestamp_utc") -> None:
    """One row: parameters, rows, first and last timestamp."""
    run = df.agg(F.count("*").alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    run.select(*[F.lit(v).alias(k) for k, v in parameters.items()], "*").coalesce(1).write.mode("errorifexists").json(path)
