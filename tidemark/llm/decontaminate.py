"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document long, so their Jaccard similarity says little; what counts is
the share of the item's shingles that the document holds. Items are partitioned by their number of
distinct shingles. Each partition has its own sketch size: of every item it indexes the s smallest
shingle hashes (a bottom-s MinHash sketch). An item of q shingles of which a document holds at
least ``containment`` misses at most ``q - ceil(containment * q)`` of them, so at least s minus that
many of its sketch are found in the document; s is one above what the partition's largest item may
miss, or more. Documents' rolling shingle hashes are joined with the sketches, items whose sketch
hits suffice are candidates, and only candidates are verified, by exact containment of shingle
texts. No pair at or above the threshold is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, columns_of, saved, unused, with_rolling

WORDS, CONTAINMENT = 5, 0.8
#: Smallest sketch, and the number of sketch hashes up to which they are broadcast (12 bytes each).
LEAST_SKETCH, MOST_BROADCAST = 8, 500_000
#: Bytes of the items' shingle texts up to which these are broadcast.
MOST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    return alnum_words(ascii_lower(F.coalesce(text, F.lit(""))))


def _shingles(words: str, k: int) -> Column:
    """Distinct shingle texts of ``k`` words of column ``words``."""
    count = F.size(words) - k + 1
    made = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.when(count >= 1, made).otherwise(F.array().cast("array<string>")))


def _hash_of(k: int) -> Column:
    """What with_rolling() gives for a shingle text."""
    words = F.split("shingle", " ")
    return F.xxhash64(*[F.xxhash64(F.get(words, j)) for j in range(k)])


def _found(docs: DataFrame, benchmark: DataFrame, words: int, containment: float) -> DataFrame:
    """``doc_id, text_hash, item_id, item_shingles, found`` for each text and item as matches() tells."""
    item_words = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    item_words = item_words.withColumn("k", F.least(F.size("words"), F.lit(words)))
    widths = sorted(r[0] for r in item_words.select("k").distinct().collect())  # at most ``words`` values
    if not widths:
        kind = benchmark.schema["item_id"].dataType
        return docs.where("false").select(
            "doc_id", F.lit(None).cast("long").alias("text_hash"), F.lit(None).cast(kind).alias("item_id"), F.lit(0).cast("long").alias("item_shingles"), F.lit(0).cast("long").alias("found")
        )
    chosen, hashed = F.array().cast("array<string>"), F.lit(None).cast("long")
    for k in widths:
        chosen = F.when(F.col("k") == k, _shingles("words", k)).otherwise(chosen)
        hashed = F.when(F.col("k") == k, _hash_of(k)).otherwise(hashed)
    items = saved(
        item_words.select("item_id", "words", "k", chosen.alias("shingles"))
        .select(F.xxhash64("item_id", "words").alias("item"), "item_id", "k", F.size("shingles").cast("long").alias("item_shingles"), F.explode("shingles").alias("shingle"))
        .withColumn("hash", hashed),
        "items",
    )

    # size partitions: powers of two; misses and sketch sizes follow from a partition's largest item
    q = F.col("item_shingles")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(q.cast("double"))))
    sketch = F.greatest(F.lit(LEAST_SKETCH), upper - F.ceil(upper * containment) + 1)
    allowed = q - F.ceil(q * containment - 1e-9)
    ranked = items.select("item", "hash", "k", q, sketch.cast("long").alias("s"), allowed.alias("allowed")).distinct()
    per_item = ranked.groupBy("item", "k", "item_shingles", "s", "allowed").agg(F.sort_array(F.collect_set("hash")).alias("all"))
    index = saved(
        per_item.withColumn("sketch", F.slice("all", 1, F.col("s").cast("int")))
        .select("item", "k", (F.size("sketch") - F.col("allowed")).alias("needed"), F.explode("sketch").alias("hash")),
        "sketches",
    )
    small = index.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    # the texts of all shingles are broadcast by their own size
    n_bytes = items.agg(F.sum(F.octet_length("shingle") + 64)).first()[0] or 0
    few_facts = n_bytes <= MOST_BYTES

    text_words = _words(F.col("text"))
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    # explode_outer: explode has Spark filter on the array's size first, which computes it once more, below
    # the projections that keep the hashes from being computed for each position
    worded = with_rolling(docs.select(*key, text_words.alias("words")), "words", widths)


    def tagged(k: int) -> Column:
        return F.transform(f"rolling_{k}", lambda h: F.struct(F.lit(k).alias("k"), h.alias("hash")))

    if len(widths) == 1:
        probes = worded.select("doc_id", "text_hash", F.explode_outer(f"rolling_{widths[0]}").alias("hash")).withColumn("k", F.lit(widths[0]))
    else:
        probes = worded.select("doc_id", "text_hash", F.explode_outer(F.concat(*map(tagged, widths))).alias("h")).select("doc_id", "text_hash", "h.k", "h.hash")
    hits = probes.join(F.broadcast(index) if small else index, ["hash", "k"])
    candidates = (
        hits.groupBy("doc_id", "text_hash", "item", "needed").agg(F.count_distinct("hash").alias("hits"))
        .where("hits >= greatest(needed, 1)").select("doc_id", "text_hash", "item")
    )
    candidates = saved(candidates, "candidates")

    # exact: the candidates' documents are read again, all others are left out before their words are made
    wanted = candidates.select("doc_id", "text_hash").distinct()
    again = docs.select(*key, "text").join(
        wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")),
        F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")), "left_semi",
    )
    again = again.select("doc_id", "text_hash", text_words.alias("words"))
    spelled = again.select("doc_id", "text_hash", F.explode_outer(F.concat(*[_shingles("words", k) for k in widths])).alias("shingle")).distinct()
    facts = items.select("item", "item_id", "item_shingles", "shingle")
    expected = candidates.join(F.broadcast(facts) if few_facts else facts, "item")
    return (
        expected.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "item", "item_id", "item_shingles", F.col("shingle").alias("c_shingle"))
        .join(spelled, (F.col("text_hash") == F.col("c_hash")) & (F.col("shingle") == F.col("c_shingle")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
        .groupBy("doc_id", "item", "item_id", "item_shingles", "text_hash").agg(F.count("*").alias("found"))
        .where(F.col("found") >= F.ceil(F.col("item_shingles") * containment - 1e-9))
    )


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, item_shingles, found, containment`` for each document text and item of which
    the text holds at least ``containment`` of the distinct shingles.

    Texts are taken whole, A-Z lower-cased, words being runs of digits, letters and non-ASCII
    characters. An item of fewer than ``words`` words is one shingle of all of them; an item without
    words, or null, matches nothing, and so does a null or empty document. Repeated rows of a
    document or an item give one row. A null doc_id or item_id is an id like any other. Other
    columns are ignored; empty tables give no rows.
    """
    found = _found(docs, benchmark, words, containment)
    return (
        found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("found") / F.col("item_shingles")).alias("containment"), "item_shingles", "found")).alias("best"))
        .select("doc_id", "item_id", "best.item_shingles", "best.found", "best.containment")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the texts that hold a test item; other texts of the same doc_id, or of a null one, stay.
    Null and empty texts stay, repeated rows go or stay together, and columns stay as they were, whatever
    their names. An empty benchmark takes nothing; an empty table gives none."""
    bad, bad_hash, own_hash = unused(docs.columns, "bad", "bad_hash", "own_hash")
    leaks = _found(docs, benchmark, words, containment).select(F.col("doc_id").alias(bad), F.col("text_hash").alias(bad_hash)).distinct()
    ready = docs.select(*columns_of(docs), F.xxhash64("text").alias(own_hash))
    kept = ready.join(leaks, F.col("doc_id").eqNullSafe(F.col(bad)) & (F.col(own_hash) == F.col(bad_hash)), "left_anti")
    return kept.select(*columns_of(docs))
