"""Line dedup: frequent lines go, but for those of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACE_CHARS, ascii_lower, columns_of, join_hot_apart, saved, unused

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Lines that are broadcast at most (24 bytes each): those that make up 1 / HOT_KEYS of all long lines or more.
HOT_KEYS = 1000


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _hashes(least_chars: int) -> Column:
    """Position and hash (two XXH64 over different bytes: 128 bits) of each line that is long enough."""
    keys = F.transform(F.split(ascii_lower(_text()), "\n"), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(SPACE_CHARS)).alias("key")))
    return F.transform(
        F.filter(keys, lambda x: F.char_length(x["key"]) >= least_chars),
        lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(x["key"], F.lit(1)).alias("h2")),
    )


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs`` with ``kept_text, n_lines, n_dropped`` added.

    A text is split at newlines (null or empty: one empty line). A line's key is the line without
    ASCII white space at its ends, A-Z lower-cased. Keys of at least ``least_chars`` code points that
    at least ``least_documents`` doc_ids hold lose all their lines except those in the largest of
    these doc_ids. Repeated rows of one doc_id are one document in the count and lose the same
    lines; a null doc_id counts as one document, below every other. Other columns are carried
    along whatever their names, but for columns of the three names above, which are replaced. An
    empty table gives none.
    """
    rest = columns_of(docs, ("kept_text", "n_lines", "n_dropped"))
    own_id, own_hash, d_id, d_hash, gone, parts = unused(docs.columns, "own_id", "own_hash", "d_id", "d_hash", "gone", "parts")
    ident = F.coalesce("doc_id", F.lit(NO_ID))
    # only 32 bytes a long line leave the scan; a text is told by doc_id and hash
    lines = saved(
        docs.select(ident.alias("id"), F.xxhash64(_text()).alias("text_hash"), F.explode_outer(_hashes(least_chars)).alias("line"))
        .where("line is not null").select("id", "text_hash", "line.pos", "line.h1", "line.h2"),
        "lines",
    )
    frequent = (
        lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("times"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.max("id").alias("keeper"))
        .where(F.col("n") >= least_documents).select("h1", "h2", "keeper", "times")
    )
    frequent = saved(frequent, "frequent")
    # a line of very many documents is not shuffled by its hash: keys with a share of 1 / HOT_KEYS of all
    # lines or more are HOT_KEYS at most, so that their broadcast has a bound
    hot = F.col("times") * HOT_KEYS >= lines.count()
    dropped = (
        join_hot_apart(lines, frequent, ["h1", "h2"], "keeper", hot).where("id <> keeper")
        .groupBy(F.col("id").alias(d_id), F.col("text_hash").alias(d_hash)).agg(F.collect_set("pos").alias(gone))
    )
    dropped = saved(dropped, "dropped")
    # the rows of `dropped` are unique, so a row of docs meets one at most
    joined = docs.select(*rest, ident.alias(own_id), F.xxhash64(_text()).alias(own_hash)).join(
        dropped, (F.col(own_id) == F.col(d_id)) & (F.col(own_hash) == F.col(d_hash)), "left"
    )
    # a projection of its own: within a lambda the text would be split for each line
    cut = joined.withColumn(parts, F.split(_text(), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return cut.select(
        *rest,
        F.when(F.col(gone).isNull(), _text()).otherwise(kept).alias("kept_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
