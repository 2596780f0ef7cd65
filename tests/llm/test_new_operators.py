"""Merkle manifest, packing and fill-in-the-middle against plain Python."""

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import infill, merkle, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab cé ß中🙂\n.,'İ<P>") for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), "en", f"s{i % 3}", i) for i in range(70)]
    rows += [(100 + i, text(30), "de", None, None) for i in range(33)]
    rows += [(200, None, "fr", "s1", 3), (201, "", None, "s1", 0), (202, "x", None, "s1", 1), (None, "no id", "en", "s0", 5), (None, None, "de", None, None)]
    return rows + [(5, "again", "en", "s0", 5), (5, "again", "en", "s0", 5), (5, "again", "en", "s1", 5), (300, "y", "", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(3).cache()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- Merkle manifest


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_manifest(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, leaves = {}, {}
    for lang in langs:
        leaves[lang] = sorted(((r[0], leaf_of(r)) for r in by[lang]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = climb([x[1] for x in leaves[lang]], fanout)
    top = climb([trees[x][-1][0] for x in langs], fanout)
    out = []
    for g, lang in enumerate(langs):
        for i, (doc_id, leaf) in enumerate(leaves[lang]):
            path = []
            for levels, at in ((trees[lang], i), (top, g)):
                for level in levels[:-1]:
                    first = at // fanout * fanout
                    path.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
                    at //= fanout
            out.append((doc_id, lang, leaf, trees[lang][-1][0], top[-1][0], path))
    return out


def some_leaves(docs):
    return docs.withColumn("leaf", merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))


def as_key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("fanout, broadcast", [(2, 50_000), (3, 0)])
def test_manifest_equals_plain_trees(docs, fanout, broadcast, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", broadcast)
    found = merkle.manifest(some_leaves(docs), "lang", "doc_id", fanout=fanout).collect()
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in found]
    # rows that are equal in all columns are leaves side by side: which is which is open
    assert sorted(got, key=as_key) == sorted(plain_manifest(some_rows(), fanout), key=as_key)


@pytest.mark.parametrize("count", [1, 33, 1025])
def test_trees_of_all_depths(spark, count):
    rows = [(i, "t", "en", "s", i) for i in range(count)]
    done = merkle.manifest(some_leaves(spark.createDataFrame(rows, SCHEMA)), "lang", "doc_id")
    shown = done.select("*", merkle.proof_hash(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("again")).collect()
    want = {x[0]: x for x in plain_manifest(rows, 2)}
    assert len(shown) == count
    for r in shown:
        _, _, leaf, subroot, root, path = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"], r["again"]) == (leaf, subroot, root, root)
        assert r["proof"] == sha("".join(a + b for a, b in path))


def test_a_changed_row_is_found(spark, docs):
    done = merkle.manifest(some_leaves(docs), "lang", "doc_id")
    other = done.select("root", merkle.folded(F.sha2(F.col("leaf"), 256), F.col("path")).alias("folded"))
    assert other.where("root = folded").count() == 0
    assert done.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_of_odd_tables(spark, docs):
    leaves = some_leaves(docs)
    assert merkle.manifest(leaves.limit(0), "lang", "doc_id").count() == 0
    names = "rank part g idx total first own grp grp_ low n p_ g_up idx_up below_up path_up g_own idx_own below hash range shift path subroot root c0_1".split()
    wide = leaves.select("*", *[F.lit(7).alias(n) for n in names])
    got = merkle.manifest(wide, "lang", "doc_id")
    assert sorted(got.columns) == sorted(wide.columns)
    plain = merkle.manifest(leaves, "lang", "doc_id")
    pick = lambda df: sorted(((r["doc_id"], r["leaf"], r["root"], len(r["path"])) for r in df.collect()), key=as_key)
    assert pick(got) == pick(plain)
    assert {r[0] for r in got.select("rank").collect()} == {7}


def test_many_groups(spark):
    rows = [(i, "t", f"l{i % 97}", "s", i) for i in range(300)]
    found = merkle.manifest(some_leaves(spark.createDataFrame(rows, SCHEMA)), "lang", "doc_id").collect()
    got = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in found]
    assert sorted(got) == sorted(plain_manifest(rows, 2))


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_chunks_equal_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    pool = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　​abcABC'sS’ßÄÖüéÉÇİıΣσςẞTẗ̈̇́.,;:!?12③²ªº中文ﬁŉǅ-<|>_\0"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["it's <|endoftext|> x", "", " ", "don't, WE'LL.", "a" * 300, "̈x", "é.́"]
    # whatever either side may take for white space or join with its neighbours
    odd = [chr(c) for c in range(0x3000 + 1) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cf", "Zs", "Zl", "Zp") or unicodedata.combining(chr(c))]
    texts += [f"a{c}B {c}c, d{c} 1{c}'s" for c in odd]
    enc = packing.ChunkEncoder(tokenizer)
    assert enc.chunked
    want = [np.array(e.ids, enc.dtype).tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert enc.ids(texts) == want
    assert enc.ids(texts) == want  # remembered


@pytest.mark.parametrize("normalizer, cut", [("NFD", None), (None, "[^ ]+")])
def test_other_tokenizers_get_whole_texts(tokenizer, tmp_path, normalizer, cut):
    spec = json.loads(open(tokenizer).read())
    if normalizer:
        spec["normalizer"]["normalizers"][0]["type"] = normalizer
    if cut:
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = cut
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc = packing.ChunkEncoder(str(tmp_path / "t.json"))
    assert not enc.chunked
    texts = ["Élan, vital.", "", "a b"]
    assert enc.ids(texts) == enc.whole(texts)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 200])
    counts = Counter(min(capacity, int(rng.paretovariate(0.8))) for _ in range(rng.randint(1, 3000)))
    slots = packing.plan(counts, capacity)
    fill, taken = {}, Counter()
    for length, low, high, each, sequence, at in slots:
        assert taken[length] == low and (high - low) % each == 0
        taken[length] = high
        for rank in range(high - low):
            fill.setdefault(sequence + rank // each, []).append((at + rank % each * length, length))
    assert taken == counts
    for places in fill.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= capacity
    # best fit one document at a time fills as many sequences
    free = Counter()
    for length in sorted(counts.elements(), reverse=True):
        fit = min((f for f, n in free.items() if f >= length and n), default=capacity)
        if free[fit]:
            free[fit] -= 1
        free[fit - length] += 1
    assert len(fill) == sum(free.values())


@pytest.mark.parametrize("capacity, broadcast", [(2048, 500_000), (16, 500_000), (16, 0)])
def test_packing_equals_plain_ids(spark, docs, tokenizer, capacity, broadcast):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    more = docs.select("*", *[F.lit(1).alias(c) for c in "shard piece start length ordinal width ids base rank each sequence at n offset parts pieces".split()])
    packed = packing.pack(more, tokenizer, capacity, broadcast_rows=broadcast)
    got = [tuple(r) for r in packing.placements(packed).collect()]
    want = []
    for doc_id, text, *_ in some_rows():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc_id, n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
    assert sorted([r[:5] for r in got], key=as_key) == sorted(want, key=as_key)
    fill = {}
    for r in got:
        fill.setdefault(r[5], []).append((r[6], r[3]))
    for places in fill.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= capacity
    whole = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r[3] for r in want) and len(whole) == len(fill)


def test_packing_of_an_empty_table(spark, docs, tokenizer):
    assert packing.placements(packing.pack(docs.limit(0), tokenizer)).count() == 0


# --- fill-in-the-middle


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:low], text[low:high], text[high:]
    made = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, made[0], low, high - low, made[1])


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_infill_equals_plain_python(spark, docs, window, monkeypatch):
    monkeypatch.setattr(infill, "WINDOW", window)
    more = docs.select("*", *[F.lit(7).alias(c) for c in "hashed low high form output n".split()])
    done = infill.fill_in_middle(more)
    got = [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in done.collect()]
    assert sorted(got, key=as_key) == sorted((plain_infill(*r[:2]) for r in some_rows()), key=as_key)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    assert done.where(infill.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert {r[0] for r in done.select("hashed").collect()} == {7}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_windows_cut_within_code_points():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aé中🙂"), rng.integers(0, 30))) for _ in range(60)]
    n = np.array([len(t) for t in texts])
    a, b = rng.integers(0, n + 1), rng.integers(0, n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    whole = infill._cut(pa.array([None, *texts, ""]).slice(1, 60), low, high)
    assert [x.to_pylist() for x in whole] == [[t[i:j].encode() for t, i, j in zip(texts, x, y)] for x, y in ((0 * n, low), (low, high), (high, n))]


def test_markers_half_in_a_text(spark):
    rows = [(i, t) for i, t in enumerate(["<S", "<", ">", "<<>>", "P><S<M", "a<", "<P <S <M"] * 40)]
    done = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), plain_percent=0)
    assert done.where((infill.restored(F.col("output"), F.col("form")) != F.col("text")) | (F.col("form") == "plain")).count() == 0


def test_a_text_of_many_megabytes(spark, tokenizer):
    text = "Wörter und words, " * 300_000
    table = spark.createDataFrame([(1, text, "en", "s", 1), (2, "short", "en", "s", 1)], SCHEMA)
    done = infill.fill_in_middle(table, plain_percent=0)
    assert done.where((infill.restored(F.col("output"), F.col("form")) == F.col("text")) & (F.char_length("output") > F.col("n"))).count() == 2
    packed = packing.pack(table, tokenizer)
    whole = sum(len(b) // 2 + 1 for b in packing.ChunkEncoder(tokenizer).whole([text, "short"]))
    assert packed.agg(F.sum("length")).first()[0] == packing.sequences(packed).agg(F.sum("n_tokens")).first()[0] == whole
    assert merkle.manifest(some_leaves(table), "lang", "doc_id").count() == 2
