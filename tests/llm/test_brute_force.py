"""Operators without SQL against plain Python, clashing columns, ties and very long texts."""

import hashlib
import inspect
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, fingerprints, language, licenses, lines, mixing, quality, simhash, tokens, urls

from .test_operators import WORDS, brute_components, brute_simhash, rows, shingles, some_docs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
M64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).cache()


def tokenizer():
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


# --- columns of any name ----------------------------------------------------------------------------
def internal_names(module, keep):
    """Every name that the module's source writes in quotes, and what unused() makes of them."""
    found = set(re.findall(r'"(_*[a-z][a-z0-9_]*)"', inspect.getsource(module) + inspect.getsource(common)))
    return sorted(n for n in found | {f"_{n}" for n in found} if n not in keep)


def benchmark(spark):
    text = {d: t for d, t, _, _ in some_docs()}
    return spark.createDataFrame([(1, " ".join(text[401].split()[100:140])), (2, text[5])], "item_id long, text string")


CASES = {
    "lines": (lines, lambda s, d: lines.drop_lines(d).select("doc_id", "kept_text", "n_lines", "n_dropped"), ["kept_text", "n_lines", "n_dropped"]),
    "mixing": (mixing, lambda s, d: mixing.mix(d), []),
    "simhash": (simhash, lambda s, d: simhash.one_of_each(d), []),
    "near_duplicates": (simhash, lambda s, d: simhash.near_duplicates(d), []),
    "decontaminate": (decontaminate, lambda s, d: decontaminate.without_leaks(d, benchmark(s)), []),
    "language": (language, lambda s, d: language.keep_known(d), []),
    "licenses": (licenses, lambda s, d: licenses.scan(d, licenses.template_table(s)), []),
    "fingerprints": (fingerprints, lambda s, d: fingerprints.compare_edited(d), []),
    "fingerprint": (fingerprints, lambda s, d: fingerprints.fingerprint(d).select("doc_id", "text", "fingerprint"), ["fingerprint"]),
    "quality": (quality, lambda s, d: quality.classify(d, s.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (100, 0)], "doc_id long, quality int")), []),
    "tokens": (tokens, lambda s, d: tokens.digests(d, tokenizer()), []),
}


@pytest.mark.parametrize("case", CASES)
def test_extra_columns_of_any_name(spark, docs, case):
    module, run, replaced = CASES[case]
    names = internal_names(module, {"doc_id", "text", "lang", "source"}) + ["a.b", "with space", "Gone", "OWN_ID"]
    wide = docs.select("*", *[F.lit(7).alias(n) for n in {n.lower(): n for n in names}.values()])
    got, want = run(spark, wide), run(spark, docs)
    kept = [f"`{c}`" for c in want.columns]
    assert rows(got.select(*kept)) == rows(want)
    if len(got.columns) > len(want.columns):
        assert got.columns == wide.columns and got.where(" or ".join(f"`{c}` <> 7" for c in got.columns if c not in want.columns)).count() == 0


def test_identify_and_judge_take_extra_columns(spark):
    r = spark.createDataFrame([(1, "the and of", "a.fr", None)], "n int, text string, host string, declared string")
    model = np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 5)).astype(np.float32)
    names = internal_names(language, {"n", "text", "host", "declared"})
    wide = r.select("*", *[F.lit(7).alias(n) for n in names])
    got, want = language.identify(wide, model), language.identify(r, model)
    assert got.select(*want.columns).first() == want.first()
    assert set(got.columns) == set(wide.columns) - {"text"} | {"language", "posterior", "kept"} and len(got.columns) == len(set(got.columns))
    p = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    wide = p.select("*", *[F.lit(7).alias(n) for n in internal_names(urls, {"page_id", "url"})])
    assert urls.judge(wide, urls.rule_table(spark)).first() == urls.judge(p, urls.rule_table(spark)).first()


# --- op1 --------------------------------------------------------------------------------------------
def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(5)
    for case in range(60):
        n = int(rng.integers(1, 80))
        p, size, times = rng.random(n), rng.integers(0, 50, n).astype(float), rng.integers(1, 6, n).astype(float)
        if case % 4 == 0:
            times[:] = 1
        if case % 5 == 0:
            size[:] = 7
        out = mixing._flight(p, size * times, times, np.random.default_rng(case), False)
        assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= 2
        assert out @ (size * times) == pytest.approx(p @ (size * times), abs=1e-5) and out @ times == pytest.approx(p @ times, abs=1e-5)
        landed = mixing._flight(p, size * times, times, np.random.default_rng(case), True)
        assert set(landed) <= {0.0, 1.0}
    # no unit is favoured: on the average probabilities stay what they were
    flown = [mixing._flight(np.full(12, 0.3), np.arange(12.0) ** 2, np.ones(12), np.random.default_rng(s), False) for s in range(4000)]
    assert np.mean(flown, axis=0) == pytest.approx(np.full(12, 0.3), abs=0.03)


def test_direction_is_in_the_null_space():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([float(rng.choice([0, 1, 2, 3, 50, 10**6])) for _ in range(3)] for _ in range(2))
        if rng.random() < 0.3:
            b = [2 * x for x in a]
        m = mixing._direction(a, b)
        assert any(m) and abs(sum(map(float.__mul__, a, m))) <= 1e-6 * max(1, *a) and abs(sum(map(float.__mul__, b, m))) <= 1e-6 * max(1, *b)


def test_repeated_rows_count_as_documents(spark):
    table = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 10 + cast(id % 3 as int)) AS text", "'a' AS source", "cast(1 + id % 5 as int) AS n").selectExpr("doc_id", "text", "source", "explode(sequence(1, n))").drop("col")
    plan = mixing.plan(table, share=0.5)
    documents, words, target = plan.agg(F.sum(F.col("copies") * F.col("rows")), F.sum(F.col("copies") * F.col("rows") * F.col("size")), F.max("target")).first()
    assert abs(documents - 600) <= 5 and abs(words - target) <= 60


# --- op3 --------------------------------------------------------------------------------------------
def test_words_out_of_order_are_no_license(spark):
    apache = "licensed under the apache license version 2 0"
    cases = {
        1: "2 0 version 2 license version apache license the apache under the licensed under",
        2: apache, 3: "licensed under the brand new apache license version 2 0", 4: f"{apache} and {apache}", 5: "licensed under " * 50 + "apache license " * 50 + "version 2 0",
        6: "licensed under the apache software license version 2 0", 7: " ".join(reversed(apache.split())), 8: None, 9: "",
    }
    table = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    one = licenses.template_table(spark, [], [(apache, "apache")])
    got = {r.doc_id: (r.labels, round(r.score, 4)) for r in licenses.scan(table, one).collect()}
    # 7 pairs: two words put in take one pair away, one word within "apache license" too
    assert got[2] == ("apache", 1.0) and got[3] == ("apache", round(6 / 7, 4)) and got[4] == ("apache", 1.0) and got[6] == ("apache", round(6 / 7, 4))
    assert got[1][0] == got[5][0] == got[7][0] == got[8][0] == got[9][0] == "" and got[8][1] == got[9][1] == 0.0


def test_spans_equal_brute_force(spark):
    rng = random.Random(11)
    template = "a b c a d b e f c g".split()
    pairs = list(zip(template, template[1:]))
    texts = [(i, " ".join(rng.choice("abcdefghxy") if rng.random() < 0.4 else template[j % 10] for j in range(rng.randint(0, 40)))) for i in range(60)]
    got = {r.doc_id: r.score for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), licenses.template_table(spark, [], [(" ".join(template), "t")])).collect()}
    for i, t in texts:
        w = t.split()
        votes = [(p, j) for p in range(len(w) - 1) for j, q in enumerate(pairs) if (w[p], w[p + 1]) == q]
        best = 0
        for start in {p - j for p, j in votes}:
            span = sorted((p, j) for p, j in votes if start <= p - j <= start + licenses.GAP)
            run = []
            for n, (p, j) in enumerate(span):  # longest run that rises in both
                run.append(1 + max((run[k] for k in range(n) if span[k][0] < p and span[k][1] < j), default=0))
            best = max(best, *run)
        assert got[i] == pytest.approx(best / len(pairs)), t


# --- op4 --------------------------------------------------------------------------------------------
def mix64(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_signature(text, bins=512, bits=4):
    found = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    h = [xxhash.xxh64_intdigest(w, 7) for w in found]
    if not h:
        return None
    width, values = min(5, len(h)), [None] * bins
    for i in range(len(h) - width + 1):
        x = width
        for j in range(width):
            x = mix64((x * 0x9E3779B97F4A7C15 + h[i + j]) & M64)
        b = x >> 64 - bins.bit_length() + 1
        values[b] = x if values[b] is None else min(values[b], x)
    full = [v is not None for v in values]
    for b in range(bins):
        tries = 0
        while values[b] is None:
            tries += 1
            source = mix64((b * (1 << 20) + tries) * 0x9E3779B97F4A7C15 & M64) % bins
            values[b] = values[source] if full[source] else None
    return [v & (1 << bits) - 1 for v in values]


def plain_pack(values):
    return "" if values is None else bytes(a | b << 4 for a, b in zip(values[::2], values[1::2])).hex()


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    share = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(1.0, max(0.0, (share - 1 / 16) / (1 - 1 / 16)))


def edited_rows(table):
    keyed = sorted(((-(2**63) if d is None else d, xxhash.xxh64_intdigest((t or "").encode(), 42), t or "") for d, t in table), key=lambda r: (r[0], r[1] - (1 << 64) if r[1] >> 63 else r[1]), reverse=True)
    for (d, _, t), (_, _, nxt) in zip(keyed, keyed[1:] + keyed[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        s, e, n = plain_signature(t), plain_signature(edited), plain_signature(nxt)
        yield (None if d == -(2**63) else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_pack(s), plain_pack(e), round(plain_likeness(s, e), 9), round(plain_likeness(s, n), 9))


@pytest.mark.parametrize("parts", ["4", "9"])
def test_fingerprints_equal_plain_python(spark, parts):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    # a third of all rows without an id, rows of one id and text, few and many words
    table = [(d, t) for d, t, _, _ in some_docs()] + [(None, text(rng.randint(0, 60))) for _ in range(50)] + [(7, text(9)) for _ in range(10)] + [(7, "same text"), (7, "same text"), (2**60, text(700)), (2**60 + 1, "é " * 40)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.compare_edited(spark.createDataFrame(table, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(edited_rows(table), key=key)


# --- op5 --------------------------------------------------------------------------------------------
def plain_identify(table, model):
    """Posteriors by the formula: likelihood x declared x suffix x host, smoothed to its domain and to all."""
    k, out = len(model), []
    ll, p = [], []
    for t, _, _ in table:
        b = language.trigrams(t)
        v = [float(model[i, b].sum(dtype=np.float64)) / 3 for i in range(k)] if len(b) else None
        ll.append(v)
        top = max(v) if v else 0
        own = sum(math.exp(x - top) for x in v) if v else 1
        p.append([math.exp(x - top) / own for x in v] if v else [0.0] * k)
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: re.search(r"[a-z]+$", h)[0] if h and re.search(r"[a-z]+$", h) else None
    groups = {"h": [r[1] for r in table], "d": [r[1] and domain(r[1]) for r in table], "s": [suffix(r[1]) for r in table], "m": [r[2] for r in table]}
    sums = {g: {x: [sum(p[r][i] for r in range(len(table)) if keys[r] == x) for i in range(k)] for x in set(keys) - {None}} for g, keys in groups.items()}
    total = [sum(q[i] for q in p) for i in range(k)]
    base = [(x + 1) / (sum(total) + k) for x in total]
    for r in range(len(table)):
        if ll[r] is None:
            out.append(("und", 1.0))
            continue
        less = lambda g, i: max(sums[g][groups[g][r]][i] - p[r][i], 0.0) if groups[g][r] is not None else 0.0 if g in "sm" else max(-p[r][i], 0.0)
        nd, nh = (sum(less(g, i) for i in range(k)) for g in "dh")
        logs = []
        for i in range(k):
            of_domain = (less("d", i) + 20 * base[i]) / (nd + 20)
            log = ll[r][i] + math.log((less("h", i) + 20 * of_domain) / (nh + 20))
            for g in "sm":
                if groups[g][r] is not None:
                    log += math.log((less(g, i) + 0.5) / (sum(v[i] for v in sums[g].values()) + 0.5 * max(1, len(sums[g]))))
            logs.append(log)
        best = max(logs)
        out.append(((*language.LANGUAGES, "und")[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)))
    return out


def test_posteriors_equal_the_formula(spark):
    rng = random.Random(4)
    model = np.log(np.random.default_rng(1).dirichlet(np.full(language.BUCKETS, 0.5), 5)).astype(np.float32)
    hosts = ["a.x.fr", "b.x.fr", "y.de", "www.z.com", None, "127.0.0.1"]
    table = [(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), rng.choice(hosts), rng.choice(["fr", "de", None])) for _ in range(40)] + [(None, "y.de", "de"), ("123 !", None, None), ("na", "y.de", None), ("na", "y.de", None)]
    got = language.identify(spark.createDataFrame([(n, *r) for n, r in enumerate(table)], "n int, text string, host string, declared string"), model).orderBy("n").collect()
    for r, (name, posterior) in zip(got, plain_identify(table, model)):
        assert r.language == name and r.posterior == pytest.approx(posterior, abs=1e-9) and r.kept == (name != "und" and posterior >= 0.5)


def test_equal_posteriors_go_to_the_first_language(spark):
    flat = np.full((5, language.BUCKETS), -math.log(language.BUCKETS), np.float32)
    r = language.identify(spark.createDataFrame([("abc", None, None)], "text string, host string, declared string"), flat).first()
    assert r.language == "de" and r.posterior == pytest.approx(0.2) and not r.kept


def test_declared_language_stands_anywhere_in_the_tag(spark):
    pages = ["<html lang=fr>", "<HTML " + 'data-x="y" ' * 200 + "LANG='DE-at'>", "<html><p lang=es>", "<htmlx lang=en>", None, "", '<html xml:lang="de" lang="en">']
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").orderBy("i").select(language.declared_language(F.col("h"))).collect()]
    assert got == ["fr", "de", None, None, None, None, "en"]


# --- op6 --------------------------------------------------------------------------------------------
def plain_statistics(text):
    """The statistics by counting characters and words one by one."""
    words = text.split()
    data = list(text.encode())
    count = lambda keep: sum(1 for c in data if keep(c))
    upper, lower = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122)
    digits, wide = count(lambda c: 48 <= c <= 57), count(lambda c: c > 127)
    space, stops = count(lambda c: c == 32 or 9 <= c <= 13), count(lambda c: chr(c) in ".,;:?'\"-")
    sizes, n, nw = [len(w) for w in words], len(data), len(words)
    mean = sum(sizes) / nw
    lines = text.split("\n")
    follow = list(zip(words, words[1:]))
    return [
        math.log(1 + n), math.log(1 + nw), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / nw), math.sqrt(max(sizes)), len(set(words)) / nw, len(set(words)) / math.sqrt(nw),
        sum(a == b for a, b in follow) / nw, max(words.count(w) for w in words) / nw, len(set(follow)) / (nw - 1) if nw > 1 else 1.0, upper / max(1, upper + lower), digits / n,
        (n - upper - lower - digits - wide - space - stops) / n, text.count("!") / n, stops / n, wide / n, sum(not w[-1].isalnum() for w in words) / nw,
        sum(not w[0].isalnum() for w in words) / nw, math.log(1 + len(lines)), len(set(lines)) / len(lines), math.log(1 + sum(map(len, lines)) / len(lines)),
    ]


def test_statistics_equal_counts_one_by_one():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcAB 12.,!?-'\"\n\té中🙂;:") for _ in range(rng.randint(1, 200))) for _ in range(300)] + ["a", "a a a", "!", "x\ny\nx", "é"]
    for t in texts:
        if t.split():
            assert quality.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-12), t
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == [0.0] * quality.STATISTICS


def test_normal_equations_and_pooling_equal_a_direct_solve(spark):
    rng = random.Random(12)
    table = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) + ("!" * (i % 5)), i % 2) for i in range(240)]
    docs = spark.createDataFrame(table, "doc_id long, text string, quality int")
    model = quality.fit(quality.described(docs), docs.select("doc_id", "quality"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    stats = {i: np.array(quality.statistics(t)) for i, t, _ in table}
    known = np.array([stats[i] for i, _, _ in table if fold(i) != 2])
    assert model.mean == pytest.approx(known.mean(0)) and model.scale == pytest.approx(np.maximum(known.std(0), 1e-6))
    z = model.features(np.array([stats[i] for i, _, _ in table if fold(i) < 2]))
    y = np.array([q for i, _, q in table if fold(i) < 2], float)
    penalty = quality.RIDGE * len(y) * np.diag([1.0] * quality.FEATURES + [1e-9])
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y), rel=1e-5, abs=1e-7)
    held = [(float(model.raw(stats[i][None])[0]), q) for i, _, q in table if fold(i) == 3]
    bins = {}
    for s, q in held:
        bins.setdefault(math.floor(min(max(s, -1.0), 2.0) / quality.BIN), []).append(q)
    xs = sorted(bins)
    # the isotonic fit at k is the largest over i <= k of the smallest over j >= k of the mean of i..j
    mean = lambda i, j: sum(sum(bins[x]) for x in xs[i : j + 1]) / sum(len(bins[x]) for x in xs[i : j + 1])
    want = [max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    knots, levels = model.knots
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(levels, 9))) and (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    got = {r.doc_id: r for r in quality.classify(docs.drop("quality"), docs.select("doc_id", "quality")).collect()}
    for i, _, _ in table:
        assert got[i].score == pytest.approx(float(np.interp(model.raw(stats[i][None])[0], knots, levels)), abs=1e-9) and got[i].held_out == (fold(i) == 2)
    assert quality.classify(docs.drop("quality"), docs.select("doc_id", "quality"), got[0].score).where("doc_id = 0").first().predicted == 1  # at the threshold


# --- op8 --------------------------------------------------------------------------------------------
def test_of_rules_of_one_length_the_last_wins(spark):
    rules = urls.rule_table(spark, [("a.org", "/x/", "block"), ("a.org", "/x/", "allow")], [])
    pages = spark.createDataFrame([(1, "http://a.org/x/y"), (2, "http://b.a.org/x/"), (3, "http://xa.org/x/")], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.rule) for r in urls.judge(pages, rules).collect()} == {(1, "allow", "a.org/x/"), (2, "allow", "a.org/x/"), (3, "allow", None)}


def test_large_rule_and_template_sets_are_joined_in_parts(spark, docs, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole, spans = rows(urls.judge(pages, urls.rule_table(spark))), rows(licenses.scan(docs, licenses.template_table(spark)))
    monkeypatch.setattr(urls, "MOST_BROADCAST", 5)
    monkeypatch.setattr(licenses, "MOST_BROADCAST", 20)
    assert rows(urls.judge(pages, urls.rule_table(spark))) == whole
    assert rows(licenses.scan(docs, licenses.template_table(spark))) == spans


# --- op9 --------------------------------------------------------------------------------------------
def test_manhattan_distance_bounds_and_equals(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(400)] + [(0, M64), (0xAAAAAAAAAAAAAAAA, 0x5555555555555555), (M64, M64)]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = [r[0] for r in df.select(simhash.manhattan(simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b")))).collect()]
    counts = lambda p: [bin(p >> 2 * i & 3).count("1") for i in range(32)]
    assert got == [sum(abs(x - y) for x, y in zip(counts(a), counts(b))) for a, b in pairs]
    assert all(m <= bin(a ^ b).count("1") for m, (a, b) in zip(got, pairs))


@pytest.mark.parametrize("hot_cell", [2, 40])
def test_hot_cells_change_no_component(spark, hot_cell):
    rng = random.Random(1)
    flip = lambda p, n: p if not n else flip(p ^ 1 << rng.randint(0, 63), n - 1)
    centre = rng.getrandbits(64)
    prints = {flip(centre, rng.randint(0, 3)) for _ in range(500)} | {flip(centre, rng.randint(4, 9)) for _ in range(200)} | {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & M64).count("1") <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), hot_cell=hot_cell).collect()]
    assert set(got) <= want and len(got) == len(set(got)) < len(want)
    groups = lambda edges: {(r.node, r.root) for r in simhash.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert groups(got) == groups(want)


# --- very long texts --------------------------------------------------------------------------------
def test_texts_of_many_megabytes(spark):
    rng = random.Random(13)
    body = " ".join(rng.choice(WORDS) for _ in range(900_000))  # 4.8 MB
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    frequent = "this line is long enough and stands in many of the documents here"
    text = f"{body}\n{frequent}\nLicensed under the Apache License, Version 2.0. {item} cc by"
    table = spark.createDataFrame([(0, text, "en", "a")] + [(i, f"{frequent}\nx{i}", "en", "a") for i in range(1, 8)], SCHEMA)
    r = licenses.scan(table, licenses.template_table(spark)).where("doc_id = 0").first()
    n = len(text.split()) + 1  # "2.0" is two words
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (n, 1, n - 2, "cc-by") and "apache-2.0" in r.labels.split(",")
    assert [m.item_id for m in decontaminate.matches(table, spark.createDataFrame([(5, item), (6, item + " more words that are not there at all in it")], "item_id long, text string")).collect()] == [5]
    cut = lines.drop_lines(table).where("doc_id = 0").first()
    assert (cut.n_lines, cut.n_dropped) == (3, 1) and cut.kept_text == text.replace(frequent + "\n", "")
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(table).collect()}[0] == f"{brute_simhash(text):016x}"
    assert plain_pack(plain_signature(text)) == fingerprints.fingerprint(table).where("doc_id = 0").first().fingerprint
    got = {d.doc_id: d.n_tokens for d in tokens.digests(table, tokenizer()).collect()}
    assert got[0] > 900_000 and len(got) == 8
    assert mixing.plan(table, share=1.0).agg(F.max("size")).first()[0] == len(text.split())
    assert quality.classify(table, table.select("doc_id", F.lit(1).alias("quality"))).count() == 8
    assert language.keep_known(table).count() <= 8
    long_url = spark.createDataFrame([(1, "http://a.example.org/es/" + "x/" * 2_000_000)], "page_id long, url string")
    assert urls.judge(long_url, urls.rule_table(spark)).first().rule == "example.org/es/"


# --- pipeline ---------------------------------------------------------------------------------------
def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    plain = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    known = stages[0](spark, docs, SF)
    model = language.train(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("language")))
    told = plain_identify([(t, s, None) for _, t, _, s in plain], model)
    kept = [r for r, (name, p) in zip(plain, told) if name != "und" and p >= 0.5]
    assert {r.doc_id for r in known.collect()} == {r[0] for r in kept} and known.count() == len(kept)
    one = stages[1](spark, known, SF)
    components = brute_components([(d, brute_simhash(t)) for d, t, _, _ in kept])
    kept = [r for r in kept if r[0] in {c for _, _, c in components}]
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in kept)
    clean = stages[2](spark, one, SF)
    items = [shingles(r.text, min(5, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r for r in kept if not any(s and len(s & shingles(r[1], 5)) >= 0.8 * len(s) - 1e-9 for s in items)]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in kept)
    mixed = stages[3](spark, clean, SF)
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    size = {d: len((t or "").split()) for d, t, _, _ in kept}
    for t in mixing.targets(clean.select("source", F.size(F.split("text", r"[\x20\x09-\x0D]+")).cast("long").alias("size"))).collect():
        of = [d for d, _, _, s in kept if s == t.source]
        assert abs(sum(times.get(d, 0) * size[d] for d in of) - t.target) <= 1.02 * max(size[d] for d in of)
    whole = Tokenizer.from_file(tokenizer())
    want, start = [], 0
    for d, t, _, _ in sorted(kept):
        for _ in range(times.get(d, 0)):
            ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert rows(stages[4](spark, mixed, SF)) == want
