"""Best-fit packing: token ids of all documents in as few sequences of bounded length as best-fit finds.

Documents are encoded once into a table of pieces that tells each piece's place among those of its length in its part of
the table. The plan is made from the counts of the lengths alone: best-fit, longest first, over groups of equally filled
sequences, so that its size depends on the capacity and not on the documents. Pieces then take the planned slots by a
join on their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from .common import saved, slices

CAPACITY, END_ID = 2048, 0
#: Bytes of text that are encoded together, longer texts alone.
BATCH_BYTES = 1 << 24
#: Words whose ids a worker remembers (those it meets first, among them the common ones).
CACHE = 1_200_000
#: Rows of the table of (part, length) that are broadcast at most (some 50 bytes each); larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000

# The form of tokenizer whose texts can be encoded by white-space separated chunks.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library.

    A tokenizer of the form above drops white space, and neither its normalizer nor its words reach over it; so the
    chunks between white space are told apart by pyarrow, and each different one is encoded once and remembered. Texts
    with characters of ``odd`` or with a string that the tokenizer adds as a token, and those of other tokenizers go
    to the library whole.
    """

    #: Texts with these are not lower-cased beforehand: what may be or meet a combining mark.
    wide = re.compile("[^\0-\u024f]")
    #: White space to one side only, and the one letter that becomes a letter and a mark: such texts go whole.
    odd = "\x1c\x1d\x1e\x1f\u0130"
    signs = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        cut = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        shown = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.chunked = (
            spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS}
            and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [cut, shown]}
            and not spec["model"].get("dropout")
        )
        # byte-level models show bytes that are no printable characters as those from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in printable)}
        self.cache: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, chunk: str) -> bytes:
        """Ids of a chunk of lower-case letters: one unit for the merges of the library's model."""
        if not chunk.isascii():
            chunk = chunk.encode("utf-8").decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(chunk)]).tobytes()

    def _units(self, units: list[str]) -> pa.Array:
        """Ids of each of some different units."""
        found = list(map(self.cache.get, units))
        new, other = {}, []
        for u in (u for u, ids in zip(units, found) if ids is None):
            if u.isalpha() and (u.isascii() or not self.wide.search(u)) and u.lower() == u:
                new[u] = self.word(u)
            else:
                other.append(u)
        for at in range(0, len(other), 4096):
            new.update(zip(other[at : at + 4096], self.whole(other[at : at + 4096])))
        if new:
            found = [new[u] if ids is None else ids for u, ids in zip(units, found)]
        if len(self.cache) < CACHE:
            self.cache.update(new)
        return pa.array(found, pa.binary())

    def _chunked(self, texts: list[str]) -> list[bytes]:
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.cast(pa.string())
        # the signs after a word of letters are a word of their own: all words as pairs of units that follow
        # each other in the same buffer, the second one mostly empty
        core = pc.utf8_rtrim(words, self.signs)
        ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        bounds = np.repeat(ends, 2)[:-1]
        bounds[1::2] = np.where(pc.utf8_is_alpha(core), ends[:-1] + pc.binary_length(core).to_numpy(), ends[1:])
        units = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(bounds), words.buffers()[2]).dictionary_encode()
        pairs = pc.take(self._units(units.dictionary.to_pylist()), units.indices)
        known = pa.Array.from_buffers(
            pa.binary(), len(words), [None, pa.py_buffer(np.frombuffer(pairs.buffers()[1], np.int32)[: 2 * len(words) + 1 : 2].copy()), pairs.buffers()[2]]
        )
        ids = pc.take(known.cast(pa.large_binary()), flat.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
        body = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        return [body[i:j] for i, j in zip(at, at[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text, without an end id."""
        out: list[bytes] = [b""] * len(texts)
        whole, cut = [], []
        for i, t in enumerate(texts):
            if not self.chunked or any(c in t for c in self.odd) or any(a in t for a in self.added):
                whole.append(i)
            elif t and not t.isspace():
                cut.append(i)
        for at in range(0, len(whole), 64):
            for k, b in zip(whole[at : at + 64], self.whole([texts[k] for k in whole[at : at + 64]])):
                out[k] = b
        if cut:
            lower = [t.lower() if t.isascii() or not self.wide.search(t) else t for t in map(texts.__getitem__, cut)]
            for k, b in zip(cut, self._chunked(lower)):
                out[k] = b
        return out


_loaded: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


PIECES = "shard int, doc_id long, piece int, start long, length int, ordinal long, width int, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``shard, doc_id, piece, start, length, ordinal, width, ids`` of all pieces, written once: the ids of a document and
    its end id, cut after every ``capacity`` ids. ``ordinal``: the place among the pieces of one length in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                rows = []
                for doc_id, body in zip(part.column("doc_id").to_pylist(), enc.ids([t or "" for t in part.column("text").to_pylist()])):
                    body += end
                    for n, first in enumerate(range(0, len(body), capacity * width)):
                        ids = body[first : first + capacity * width]
                        length = len(ids) // width
                        rows.append((shard, doc_id, n, n * capacity, length, seen[length], width, ids))
                        seen[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)
    return saved(made, "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit, longest first, over counts of lengths: rows ``length, rank_from, rank_to, each, sequence, offset``.

    Pieces of one length and ranks from ``rank_from`` to before ``rank_to`` go, ``each`` at a time, into the sequences from
    ``sequence`` on, from token ``offset`` of them. Sequences that are equally full are one group; a length takes at
    most one group in part, so that groups and steps are bounded by the capacity, whatever the counts."""
    slots: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # by free tokens: first sequence, how many
    frees: list[int] = []  # those that have groups, ascending
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, many: int, each: int, free: int) -> None:
            nonlocal left, rank
            slots.append((length, rank, rank + many * each, each, first, capacity - free))  # noqa: B023
            rest = free - each * length  # noqa: B023
            if rest and rest not in groups:
                bisect.insort(frees, rest)
            if rest:
                groups.setdefault(rest, []).append((first, many))
            rank, left = rank + many * each, left - many * each

        while left and (at := bisect.bisect_left(frees, length)) < len(frees):
            free = frees[at]  # the fullest that fits; what is filled here has less than `length` free, or is the last
            first, many = groups[free].pop()
            if not groups[free]:
                del groups[free], frees[at]
            each = free // length
            full = min(many, left // each)
            if full:
                put(first, full, each, free)
            if full < many and left:
                put(first + full, 1, left, free)
                full += 1
            if full < many:
                if free not in groups:
                    bisect.insort(frees, free)
                groups.setdefault(free, []).append((first + full, many - full))
        each = capacity // length
        for many, some in ((left // each, each), (1, left % each)):
            if many * some:
                put(sequences, many, some, capacity)
                sequences += many
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``sequence_id, offset, doc_id, piece, start, length, width, ids``: a row for each piece of each document and its
    place in a sequence.

    Every text of ``docs`` (null: empty) is encoded whole and followed by ``end_id``; only documents of more than
    ``capacity`` ids are cut. Sequences have no gaps. A null doc_id is carried along; repeated rows are documents of
    their own; other columns are ignored; an empty table gives none. ``tokenizer`` is the file of the tokenizers
    library, at the same place on all machines."""
    spark = docs.sparkSession
    held = pieces(docs, tokenizer, capacity, end_id)
    counts = saved(held.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    # bounded by the capacity, see plan()
    slots = F.broadcast(spark.createDataFrame(plan(totals, capacity), "length int, rank_from long, rank_to long, each long, sequence long, at long"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= broadcast_rows:
        base = F.broadcast(base)
    placed = held.join(base, ["shard", "length"]).withColumn("rank", F.col("base") + F.col("ordinal"))
    placed = placed.join(slots, "length").where("rank >= rank_from and rank < rank_to").withColumn("rank", F.expr("rank - rank_from"))
    return placed.select(
        F.expr("sequence + rank div each").alias("sequence_id"), F.expr("at + rank % each * length").alias("offset"), "doc_id", "piece", "start",
        F.col("length").cast("long").alias("length"), "width", "ids",
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, width, ids`` and ``pieces``, the places of what is in them: packed pieces put together.
    A sequence's rows are bounded by its capacity."""
    place = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    grouped = packed.groupBy("sequence_id", "width").agg(F.sort_array(F.collect_list(place)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", "width", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces")).withColumn(
        "n_tokens", F.expr("octet_length(ids) div width")
    )


@arrow_udf(LongType())
def ids_crc32(ids: pa.Array, width: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of serialized ids as little-endian unsigned 32-bit integers."""
    sums = [zlib.crc32(np.frombuffer(b, f"<u{w}").astype("<u4").tobytes()) for b, w in zip(ids.to_pylist(), width.to_pylist())]
    return pa.array(sums, pa.int64())


def placements(packed: DataFrame) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece, read from the sequences."""
    each = sequences(packed).select("sequence_id", "width", "ids", F.explode("pieces").alias("p"))
    own: Column = F.substring("ids", (F.col("p.offset") * F.col("width") + 1).cast("int"), (F.col("p.length") * F.col("width")).cast("int"))
    return each.select("p.doc_id", "p.piece", "p.start", "p.length", ids_crc32(own, "width").alias("ids_crc32"), "sequence_id", "p.offset")
