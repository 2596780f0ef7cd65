"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII that is neither a digit nor a letter.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a null id where ids are ordered: before every other.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only where the session names none and
    runs on this machine alone, as in tests, a folder of this machine takes its place; elsewhere it is an
    error, since executors would write to disks that others don't see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: what follows neither
    computes it again nor depends on an executor that ran it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes of a column of texts; a row with more of them may stand alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
    return (batch.slice(at, to - at) for at, to in zip(cuts, cuts[1:]) if to > at)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Each of ``names``, with as many underscores before it as make it none of ``columns`` in any case: for
    columns that an operator adds for itself to a table that may have any others."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def columns_of(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """All columns of ``df`` but the named ones (in any case), whatever signs are in their names."""
    gone = {c.lower() for c in but}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def broadcast_parts(right: DataFrame, keys: list[str], most: int) -> list[DataFrame]:
    """``right`` in parts of about ``most`` rows, each to be broadcast: one if it is small, else several that
    are joined one after the other, so that a hot key of the other side is never shuffled."""
    parts = -(-right.count() // most)
    if parts <= 1:
        return [F.broadcast(right)]
    return [F.broadcast(right.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == n)) for n in range(parts)]


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and no other character touched."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def alnum_words(lowered: Column) -> Column:
    """The runs of digits, letters and non-ASCII characters of a text."""
    return F.array_remove(F.split(lowered, NOT_ALNUM), "")


def with_rolling(df: DataFrame, words: str, widths: list[int]) -> DataFrame:
    """``df`` with, for each k of ``widths``, column ``rolling_k`` in place of column ``words``: XXH64 of
    each k consecutive words, by position; empty below k words. Words are hashed once each, in a
    projection of its own (within a lambda they would be hashed again for each position)."""
    rest = [c for c in df.columns if c != words]
    hashed = df.select(*rest, F.transform(words, lambda w: F.xxhash64(w)).alias("__hashes"))

    def windows(k: int) -> Column:
        count = F.size("__hashes") - k + 1
        made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get("__hashes", i + j) for j in range(k)]))
        return F.when(count >= 1, made).otherwise(F.array().cast("array<bigint>")).alias(f"rolling_{k}")

    return hashed.select(*rest, *map(windows, widths))


def join_hot_apart(left: DataFrame, right: DataFrame, on: list[str], found: str, hot: Column) -> DataFrame:
    """``left`` (written already: it is read twice) joined with ``right``, which has a row a key. Keys of
    ``right`` that fulfil ``hot``, whose number must have a bound, are broadcast, so that ``left``'s rows of
    them are not shuffled to one task; the others are joined by shuffling. ``found``: a column of ``right``
    that is never null."""
    tried = left.join(F.broadcast(right.where(hot)), on, "left")
    rest = tried.where(F.col(found).isNull()).select(*left.columns).join(right.where(~hot), on)
    return tried.where(F.col(found).isNotNull()).unionByName(rest)
