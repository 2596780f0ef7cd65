"""Token-id output: documents as separately compressed frames that share a trained dictionary.

A written folder holds three Parquet tables. ``dictionary``: one row, the zstandard dictionary
trained on the serialized ids of a bounded sample, and its SHA-256. ``blocks``: rows of up to
``BLOCK_BYTES`` of frames (one longer document makes one longer block), in ascending doc_id order
within and across shards, each with the dictionary's hash, the width of an id in bytes and an index
of doc_ids, first tokens, token counts and byte offsets, so that one short document is read by
finding its block from Parquet statistics and decompressing its frame alone. ``shards``: where each
shard's first token stands in the whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, slices

END_ID = 2
BLOCK_BYTES, BLOCK_DOCS = 1 << 19, 2048
#: Documents whose ids train the dictionary (those of the smallest hashes of their ids), ids of each
#: that are used, bytes of the dictionary, and compression level.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES, LEVEL = 1000, 8192, 64 * 1024, 3
#: Pieces whose ids a worker remembers at most (those it meets first, among them the common ones): some 50 MB.
CACHE = 200_000
#: Bytes of text that are encoded together, longer texts alone: what an executor's workers hold of them at once takes
#: some twenty times as many.
BATCH_BYTES = 1 << 21

class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level BPE cuts texts before single spaces that stand before a non-space, on both sides of a
    line's end between two non-spaces, and between a letter and the signs that end a piece; no merge crosses
    such a cut. So pieces between them are told apart by pyarrow, and each different one is encoded once and
    remembered. Texts with other spaces, or with a string that the tokenizer adds as a token, go to the
    library whole.
    """

    #: A space with white space or nothing after it: the cut rule does not hold there.
    odd = re.compile(r" (?:\s|\Z)")
    #: White space beside a line's end, or any but a space: the second cut rule may not hold there.
    mixed = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\n\n|\A\n|\n\z"
    signs = string.punctuation
    #: New pieces are sent to the library many at a time, with this between them, which no token holds
    #: besides its own.
    between = "\0"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = type(self.tokenizer.pre_tokenizer).__name__
        spec = json.loads(self.tokenizer.to_str())
        before, merges = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        # a space put before each text, another cut rule or random merges: texts go to the library whole
        usual = not before.get("add_prefix_space") and before.get("use_regex", True) and not merges.get("dropout")
        self.cuts = kind == "ByteLevel" and self.tokenizer.normalizer is None and bool(usual)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        # byte-level models show bytes that are no printable characters as those from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in printable)}
        self.shown = "".join(chr(others.get(b, b)) for b in range(256))
        if self.cuts:
            (self.mark,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
            spelled = self.tokenizer.id_to_token(self.mark)
            self.cuts = not any(spelled in t and t != spelled for t in self.tokenizer.get_vocab())
        self.cache: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def pieces(self, new: list[str]) -> list[bytes]:
        """Ids of each of some pieces without ``between`` in them."""
        out, width = [], self.dtype.itemsize
        for i in range(0, len(new), 512):
            joined = self.between.join(new[i : i + 512])
            found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            body, at = found.tobytes(), 0
            for end in [*np.flatnonzero(found == self.mark).tolist(), len(found)]:
                out.append(body[at * width : end * width])
                at = end + 1
        return out

    def words(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some pieces of letters after at most one space: one unit for the merges of the library's
        model, which takes bytes as printable characters."""
        joined = "\n".join(pieces).encode("utf-8", "surrogatepass")
        shown = codecs.charmap_decode(joined, "strict", self.shown)[0].split(self.shown[10]) if pieces else []
        ids, ends, tokenize = array(self.code), [0], self.tokenizer.model.tokenize
        for s in shown:
            ids.fromlist([t.id for t in tokenize(s)])
            ends.append(len(ids) * ids.itemsize)
        body = ids.tobytes()
        return [body[i:j] for i, j in zip(ends, ends[1:])]

    def units(self, units: list[str]) -> pa.Array:
        """Ids of each of some different pieces."""
        found = list(map(self.cache.get, units))
        new = [u for u, ids in zip(units, found) if ids is None]
        if new:
            letters = [p for p in new if p.isalpha() or p[0] == " " and p[1:].isalpha()]
            made = dict(zip(letters, self.words(letters)))
            if len(made) < len(new):
                other = [p for p in new if p not in made]
                # a sign at the start would be joined with the mark before it, and white space at the end be cut by
                # the mark after it
                alone = [p for p in other if p[0] != " " and not p[0].isalnum() or p[-1].isspace()]
                joined = list(set(other).difference(alone))
                made.update(zip(joined, self.pieces(joined)))
                made.update(zip(alone, self.whole(alone)))
            found = [made[u] if ids is None else ids for u, ids in zip(units, found)]
            self.cache.update(islice(made.items(), max(0, CACHE - len(self.cache))))
        return pa.array(found, pa.binary())

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut at spaces; a piece but a text's first has the space before it."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.cast(pa.string())
        kept = pc.and_(pc.match_substring(words, "\n"), pc.match_substring_regex(words, self.mixed))
        lines = pc.split_pattern(pc.if_else(kept, "", words), "\n")
        parts, first = lines.flatten(), lines.offsets.to_numpy()
        # signs after a word of letters are a piece of their own
        core = pc.utf8_rtrim(parts, self.signs)
        core = pc.if_else(pc.utf8_is_alpha(core), core, parts)
        ends = np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1]
        bounds = np.repeat(ends, 2)[:-1]
        bounds[1::2] = ends[:-1] + pc.binary_length(core).to_numpy()
        pairs = pa.StringArray.from_buffers(2 * len(parts), pa.py_buffer(bounds), parts.buffers()[2])
        tails = pc.take(pairs, pa.array(np.arange(1, 2 * len(parts), 2))).dictionary_encode()
        # a word's first part has the space before it, each other one a line's end
        later = np.ones(len(parts), np.int8)
        later[first[:-1]] = 0
        later = pa.array(later)
        cores = pc.binary_join_element_wise(pc.take(pa.array([" ", ""]), later), core, "").dictionary_encode()
        before = pc.take(pa.concat_arrays([pa.array([b""]), self.units(["\n"])]), later)
        found = [pc.take(self.units(a.dictionary.to_numpy(zero_copy_only=False).tolist()), a.indices) for a in (cores, tails)]
        made = pc.binary_join_element_wise(before, *found, b"")
        # the ids of a word are those of its parts, which stand one after the other
        at = np.frombuffer(made.buffers()[1], np.int32)[first]
        known = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at), made.buffers()[2]])
        if pc.any(kept).as_py():
            known = pc.replace_with_mask(known, kept, self.units([" " + w for w in pc.filter(words, kept).to_pylist()]))
        ids = pc.take(known.cast(pa.large_binary()), flat.indices)
        place, at = lists.offsets.to_numpy(), np.frombuffer(ids.buffers()[1], np.int64)
        firsts = pc.take(flat.dictionary, pc.take(flat.indices, pa.array(place[:-1]))).dictionary_encode()
        heads = pc.take(self.units(firsts.dictionary.to_pylist()), firsts.indices).to_pylist()
        body = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        return [h + body[i:j] for h, i, j in zip(heads, at[place[:-1] + 1].tolist(), at[place[1:]].tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text, without an end id."""
        out: list[bytes] = [b""] * len(texts)
        whole, cut = [], []
        for i, t in enumerate(texts):
            if t:
                odd = not self.cuts or self.odd.search(t) or self.between in t or any(a in t for a in self.added)
                (whole if odd else cut).append(i)
        for i in range(0, len(whole), 64):
            for k, b in zip(whole[i : i + 64], self.whole([texts[k] for k in whole[i : i + 64]])):
                out[k] = b
        if cut:
            for k, b in zip(cut, self._cut([texts[k] for k in cut])):
                out[k] = b
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _train(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample: the documents with the smallest hashes of doc_id."""
    hashed = F.xxhash64("doc_id")
    kept = [r[0] for r in docs.select(hashed.alias("h")).orderBy("h").limit(SAMPLE_DOCS).collect()]
    if not kept:
        return b""
    # enough characters for SAMPLE_IDS ids of each, from a place of the text that the hash names; the sample
    # is of use, not a part of the output
    whole, most = F.coalesce("text", F.lit("")), 4 * SAMPLE_IDS
    at = F.pmod(hashed, F.greatest(F.char_length(whole) - most, F.lit(0)) + 1) + 1
    text = F.substring(whole, at.cast("int"), F.lit(most))
    rows = docs.where(hashed <= kept[-1]).select(hashed.alias("h"), text.alias("t")).orderBy("h", "t").limit(SAMPLE_DOCS).collect()
    enc = Encoder(tokenizer)  # not kept: the driver needs it here alone
    end = np.array([end_id], enc.dtype).tobytes()
    samples = [b[: SAMPLE_IDS * enc.dtype.itemsize] + end for b in enc.ids([r["t"] for r in rows])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve as a raw dictionary
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


BLOCK_SCHEMA = (
    "shard int, block int, first_id long, last_id long, doc_ids array<long>, starts array<long>, n_tokens array<long>, "
    "offsets array<long>, width int, dict_sha256 string, frames binary"
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write every text of ``docs`` (null: empty) with ``end_id`` appended into folder ``path``.

    ``tokenizer`` is the file of the tokenizers library, at the same place on all machines. Documents
    are in ascending doc_id order, null first; rows of one doc_id in the order of their text's hash.
    Other columns are ignored. An empty table makes a folder without documents.
    """
    spark = docs.sparkSession
    raw = _train(spark, docs, tokenizer, end_id)
    sha = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(sha, bytearray(raw), end_id)], "dict_sha256 string, dictionary binary, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        words = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        block = start = 0
        ids, starts, counts, offsets, frames, shard = [], [], [], [0], [], 0

        def made() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [shard, block, min(known, default=None), max(known, default=None), ids, starts, counts, offsets, enc.dtype.itemsize, sha, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.int32(), pa.string(), pa.binary()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, shard_of, body in zip(part.column("doc_id").to_pylist(), part.column("shard").to_pylist(), enc.ids(texts)):
                    shard = shard_of
                    frame = words.compress(body + end)
                    ids.append(doc_id)
                    starts.append(start)
                    counts.append(len(body) // enc.dtype.itemsize + 1)
                    start += counts[-1]
                    frames.append(frame)
                    offsets.append(offsets[-1] + len(frame))
                    if offsets[-1] >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield made()
                        block, ids, starts, counts, offsets, frames = block + 1, [], [], [], [0], []
        if ids:
            yield made()

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # one row a shard: as many as the write had partitions
    sums = blocks.select("shard", F.size("doc_ids").alias("n"), F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    rows, at = [], 0
    for shard, n, t in sorted(map(tuple, sums.groupBy("shard").agg(F.sum("n"), F.sum("t")).collect())):
        rows.append((shard, at, n, t))
        at += t
    spark.createDataFrame(rows, "shard int, shard_start long, n_docs long, n_tokens long").coalesce(1).write.parquet(f"{path}/shards")


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str]:
    sha, raw, _ = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError(f"the dictionary in {path} is damaged")
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.join(F.broadcast(shards), "shard"), bytes(raw), sha  # shards: a row for each partition of the write


def _decoded(batches: Iterator[pa.RecordBatch], raw: bytes, sha: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    for batch in batches:
        for i in range(batch.num_rows):
            block = {n: batch.column(n)[i].as_py() for n in ("shard_start", "doc_ids", "starts", "n_tokens", "offsets", "width", "dict_sha256", "frames")}
            if block["dict_sha256"] != sha:
                raise ValueError("a block was written with another dictionary")
            for k, doc_id in enumerate(block["doc_ids"]):
                body = reader.decompress(block["frames"][block["offsets"][k] : block["offsets"][k + 1]])
                ids = np.frombuffer(body, f"<u{block['width']}")
                if len(ids) != block["n_tokens"][k]:
                    raise ValueError(f"document {doc_id} is damaged")
                yield doc_id, block["shard_start"] + block["starts"][k], ids


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in a written folder, or of one doc_id; of
    other documents' frames in its block none is decompressed then. Documents with a null doc_id come with all
    only; repeated rows come as often as they were written; a folder of an empty table gives none."""
    blocks, raw, sha = _blocks(spark, path)
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
        at = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id)
        pick = lambda c: F.transform("at", lambda i: F.get(c, i))
        frame = F.substring("frames", F.get("offsets", F.get("at", 0)) + 1, F.get("offsets", F.get("at", F.size("at") - 1) + 1) - F.get("offsets", F.get("at", 0)))
        blocks = blocks.withColumn("at", at).where(F.size("at") > 0).select(
            "shard_start", pick("doc_ids").alias("doc_ids"), pick("starts").alias("starts"), pick("n_tokens").alias("n_tokens"),
            F.transform(F.concat(F.col("at"), F.array(F.get("at", F.size("at") - 1) + 1)), lambda i: F.get("offsets", i) - F.get("offsets", F.get("at", 0))).alias("offsets"),
            "width", "dict_sha256", frame.alias("frames"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, start, ids in _decoded(batches, raw, sha):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in a written folder: the unsigned CRC-32
    of the ids as little-endian unsigned 32-bit integers. Null doc_ids and repeated rows come as they were
    written; a folder of an empty table gives none."""
    blocks, raw, sha = _blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for d, start, ids in _decoded(batches, raw, sha):
            rows.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(rows) >= 8192:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` into the shared folder and read the digests back from there: a row for each row of
    ``docs``, as write_tokens() and read_digests() say."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_digests(spark, path)
