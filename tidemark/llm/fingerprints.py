"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Each shingle of five words is hashed once. The hash's leading bits name one of ``BINS`` bins, which
keeps its smallest hash. An empty bin takes the value of a bin that is not, chosen by a fixed hash
of its number and of the attempt (the same for all documents, so that likeness is kept). Of each
bin the low-order ``BITS`` bits are stored. Two fingerprints' share of equal bins is corrected for
the bits that agree by chance, 2 ** -BITS of those that differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID

WORDS, BINS, BITS, SEED = 5, 512, 4, 7
CACHE = 200_000


class _Words(dict):
    """Hashes of words, made on first sight; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each shingle of ``words`` white-space words, A-Z lower-cased. Fewer words:
    the whole sequence is one shingle; none: no hash."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_words) > CACHE:
        _words.clear()
    h = np.array([_words[w] for w in found], np.uint64)
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return out


def _attempts(bins: int, tries: int) -> np.ndarray:
    n = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (_mix(n * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


_tables: dict[int, np.ndarray] = {}


def signature(text: str | None, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """The ``bins`` stored values of a text; None for a text without words."""
    h = shingle_hashes(text or "")
    if not len(h):
        return None
    shift = np.uint64(64 - bins.bit_length() + 1)
    h = np.sort(h)  # the leading bits name the bin, so the first of each bin is its smallest
    at = (h >> shift).astype(np.int64)
    first = np.concatenate(([True], at[1:] != at[:-1]))
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[at[first]], full[at[first]] = h[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        if bins not in _tables:
            _tables[bins] = _attempts(bins, 64)
        table, tries = _tables[bins], 0
        while len(empty):
            if tries == table.shape[1]:  # few bins are full: more attempts, the same for all texts
                table = _tables[bins] = _attempts(bins, 2 * tries)
            source = table[empty, tries]
            ok = full[source]
            values[empty[ok]] = values[source[ok]]
            empty, tries = empty[~ok], tries + 1
    return (values & np.uint64((1 << bits) - 1)).astype(np.uint8)


def pack(values: np.ndarray | None, bits: int = BITS) -> str:
    """Hexadecimal of the values' bits side by side; "" for no values."""
    if values is None:
        return ""
    planes = np.unpackbits(values[:, None], axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity. Two texts without words are alike (1), one with a text is not (0)."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-bits
    return float(np.clip((np.mean(a == b) - chance) / (1 - chance), 0.0, 1.0))


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` with column ``fingerprint`` (replaced if there): the packed signature of the whole text,
    "" for a null text or one without words. Rows are not shuffled; equal texts get equal ones."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(signature(t, bins, bits), bits) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", of("text"))


def _cuts(keyed: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that cut rows in the order of ``key, tie`` into about ``parts`` equal parts: their keys and ties.
    A key that holds several parts (a null one's, say) is cut within by quantiles of its ties."""
    probs = [i / parts for i in range(1, parts)]
    found = keyed.agg(F.percentile_approx("key", probs, 10 * parts)).first()[0] if parts > 1 else None
    keys, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    low = np.iinfo(np.int64).min
    cuts = [(int(k), low) for k in keys]
    heavy = {int(k): int(n) for k, n in zip(keys, times) if n > 1}  # half of ``parts`` at most
    if heavy:
        inner = keyed.where(F.col("key").isin(*heavy)).groupBy("key").agg(F.percentile_approx("tie", probs, 10 * parts).alias("ties"))
        for key, ties in inner.collect():
            at = [round((i + 1) / (heavy[key] + 1) * len(ties)) - 1 for i in range(heavy[key])]
            cuts += [(key, ties[i]) for i in at]
    cuts = sorted(set(cuts))
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def _buckets(keys: np.ndarray, ties: np.ndarray, cut_keys: np.ndarray, cut_ties: np.ndarray) -> np.ndarray:
    """How many cuts are at or below each ``key, tie``."""
    low, high = (np.searchsorted(cut_keys, keys, side=side) for side in ("left", "right"))
    out = low.copy()
    for k in np.unique(low[high > low]):  # rows of a key that is cut at
        here = (low == k) & (high > low)
        top = int(high[here][0])
        out[here] = k + np.searchsorted(cut_ties[k:top], ties[here], side="right")
    return out.astype(np.int32)


def _partition_by_order(docs: DataFrame, key: Column) -> DataFrame:
    """``docs`` dealt to partitions that follow each other in descending ``key, tie`` and sorted so; the
    first rows of a partition are also sent, marked ``edge``, to the end of the one before it (those
    of the first to the last), so that every row meets its successor. Only bucket bounds and each
    bucket's largest key come to the driver: a few numbers for each partition."""
    spark = docs.sparkSession
    keyed = docs.withColumn("key", key)
    cut_keys, cut_ties = _cuts(keyed.select("key", "tie"), int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(_buckets(keys.to_numpy(np.int64), ties.to_numpy(np.int64), cut_keys, cut_ties))

    largest = keyed.select("key", "tie").groupBy(bucket_of("key", "tie").alias("b")).agg(F.max(F.struct("key", "tie")).alias("top")).collect()
    tops = sorted((b, tuple(top)) for b, top in largest)
    # the largest row of a bucket follows the last row of the next higher bucket; the largest of all the last row
    goes = {top: tops[(n + 1) % len(tops)][0] for n, (_, top) in enumerate(tops)}
    ends = {key for key, _ in goes}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, ties: pd.Series) -> pd.Series:
        own = _buckets(keys.to_numpy(np.int64), ties.to_numpy(np.int64), cut_keys, cut_ties).tolist()
        return pd.Series([[b, goes[k, t]] if k in ends and (k, t) in goes else [b] for b, k, t in zip(own, keys.tolist(), ties.tolist())])

    placed = keyed.select("*", F.posexplode(places("key", "tie")).alias("edge", "bucket"))
    return placed.repartitionById(len(cut_keys) + 1, "bucket").sortWithinPartitions("edge", F.col("key").desc(), F.col("tie").desc())


def compare_edited(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for
    each row. The next document follows in descending doc_id order (null last; rows of one doc_id in
    descending order of their text's hash; after the last comes the first). The edited text has its
    last floor(n_chars / 2) code points replaced by as many first ones, or all, of the next. Null
    texts are empty ones. Texts without words have fingerprint "" and are alike (1). Texts are
    shuffled once. Other columns are ignored; an empty table gives none.
    """
    ready = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = _partition_by_order(ready, F.coalesce("doc_id", F.lit(NO_ID)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # doc_id, text, signature of the row that waits for its successor
        ended = False
        for b in batches:
            rows = []
            for doc_id, text, edge in zip(b["key"].tolist(), b["text"], b["edge"]):
                if ended:
                    continue
                own = signature(text, bins, bits)
                if last is not None:
                    d, t, s = last
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    changed = signature(edited, bins, bits)
                    rows.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(s, bits), pack(changed, bits), likeness(s, changed, bits), likeness(s, own, bits)))
                last, ended = (doc_id, text, own), bool(edge)
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield out

    return ordered.select("key", "text", "edge").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
