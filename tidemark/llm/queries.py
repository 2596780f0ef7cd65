"""Registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, infill, language, licenses, lines, merkle, mixing, packing, quality, simhash, tokens, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.plan(_table(spark, sf_dir, "documents"))
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, by models trained on documents; of doc_id and page_id one is null."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = language.train(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("language")))
    both = language.document_rows(docs).unionByName(language.page_rows(pages), allowMissingColumns=True)
    return language.identify(both, model).select("doc_id", "page_id", "host", "declared", "language", "posterior", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda n_chars: merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampers = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampers, leaf(F.col("n_chars") + 1)).alias("tampered"))
    done = merkle.manifest(leaves, "lang", "doc_id")
    shown = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return (
        done.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"), shown.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placements(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rebuilt = infill.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(rebuilt).alias("restored_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_tokens": op2_tokens,
    "op3_licenses": op3_licenses,
    "op4_fingerprints": op4_fingerprints,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_urls": op8_urls,
    "op9_simhash": op9_simhash,
    "op10_lines": op10_lines,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_infill": op13_infill,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, (bool, int)) else _text(x) for x in r) + ")" for r in rows)


#: Phrases and templates with their words as text, rules and patterns: the constants of the operators.
_TEMPLATES = _values([(n, label, n < len(licenses.BASE), text) for n, (text, label) in enumerate([*licenses.BASE, *licenses.TEMPLATES])])
_RULES = _values([(n, *r) for n, r in enumerate(urls.BASE)])
_PATTERNS = _values([(n, p, v) for n, (p, _, v) in enumerate(urls.PATTERNS)])

ORACLE_SQL = {
    "op3_licenses": rf"""
WITH templates(no, label, base, phrase) AS (VALUES {_TEMPLATES}),
t AS (SELECT no, label, base, string_split(phrase, ' ') AS w FROM templates),
pairs AS (SELECT no, label, base, j, w[j + 1] AS w1, w[j + 2] AS w2 FROM (SELECT *, unnest(range(len(w) - 1)) AS j FROM t)),
seeds AS (SELECT no, count(*) AS seeds FROM pairs GROUP BY no),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dp AS (SELECT r, i, w[i + 1] AS w1, w[i + 2] AS w2 FROM (SELECT r, w, unnest(range(len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
votes AS (SELECT r, no, label, base, i, j, i - j AS diagonal FROM dp JOIN pairs USING (w1, w2)),
diagonals AS (SELECT r, no, label, base, seeds, diagonal, list(struct_pack(i := i, b := -j)) AS vs, base AND count(*) = seeds AS place FROM votes JOIN seeds USING (no) GROUP BY r, no, label, base, seeds, diagonal),
near AS (SELECT *, list(vs) OVER (PARTITION BY r, no ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {licenses.GAP} FOLLOWING) AS spans FROM diagonals),
merged AS (
  SELECT r, label, base, place, diagonal,
    CASE WHEN base THEN place::INT::DOUBLE ELSE len(list_reduce(list_transform(list_sort(flatten(spans)), lambda v: [-v.b]),
      lambda tails, x: list_concat(list_concat(list_filter(tails, lambda y: y < x[1]), x), list_filter(tails, lambda y: y >= x[1])[2:]))) / seeds::DOUBLE END AS share
  FROM near),
scans AS (
  SELECT r, count(*) FILTER (place) AS n_base, min(diagonal) FILTER (place) AS first_word, max(diagonal) FILTER (place) AS last_word, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR NOT base AND share >= {licenses.COVER}) AS labels
  FROM merged GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN scans USING (r)
""",
    "op8_urls": rf"""
WITH rules(no, r_host, r_path, verdict) AS (VALUES {_RULES}), patterns(no, pattern, verdict) AS (VALUES {_PATTERNS}),
u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
p AS (
  SELECT r, page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
ruled AS (
  SELECT r, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY r),
matched AS (
  SELECT r, arg_max(pattern, length(pattern) * 1000 + no) AS pattern, arg_max(patterns.verdict, length(pattern) * 1000 + no) AS verdict
  FROM p JOIN patterns ON regexp_matches(host || path, pattern) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, matched.verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN ruled USING (r) LEFT JOIN matched USING (r)
""",
    "op7_decontamination": rf"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s, least(5, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT k FROM items),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, widths WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, count(*) AS found FROM shingles JOIN items USING (s) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, found, found / item_shingles::DOUBLE AS containment
FROM hits JOIN sizes USING (item_id) WHERE found >= ceil(item_shingles * 0.8 - 1e-9)
""",
    "op10_lines": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM parts),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, line, pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op11_merkle": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: list_transform(range(8), lambda b: (ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT >> b) & 1)))),
      lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
low AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS hs FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range((len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], ''))) FROM low WHERE len(hs) > 1),
subroots AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM low WHERE len(hs) = 1),
high AS (
  SELECT 0 AS level, list(subroot ORDER BY g) AS hs FROM subroots
  UNION ALL SELECT level + 1, list_transform(range((len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], ''))) FROM high WHERE len(hs) > 1),
steps AS (
  SELECT p.doc_id, p.lang, p.i, 0 AS part, level, (p.i >> level) % 2 AS slot, coalesce(hs[xor(p.i >> level, 1) + 1], '') AS sibling
  FROM placed p JOIN low ON p.lang IS NOT DISTINCT FROM low.lang AND len(hs) > 1
  UNION ALL SELECT p.doc_id, p.lang, p.i, 1, level, (g >> level) % 2, coalesce(hs[xor(g >> level, 1) + 1], '')
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high ON len(hs) > 1),
proofs AS (
  SELECT lang, i, string_agg(sibling, '' ORDER BY part, level) AS siblings, list(CASE slot WHEN 1 THEN '<' ELSE '>' END || sibling ORDER BY part, level) AS path
  FROM steps GROUP BY lang, i)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (
  SELECT p.doc_id, leaf, subroot, (SELECT hs[1] FROM high WHERE len(hs) = 1) AS root, siblings,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda h, s: sha256(CASE s[1] WHEN '<' THEN substr(s, 2) || h ELSE h || substr(s, 2) END)) AS folded_root
  FROM placed p LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.i = q.i JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang)
""",
    "op13_infill": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (
  SELECT *, list_transform(range(4), lambda k: list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: (strpos('0123456789abcdef', h[8 * k + i + 1]) - 1)::BIGINT)),
    lambda a, x: a * 16 + x)) AS d FROM t),
cuts AS (
  SELECT doc_id, text, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
      WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
pieces AS (
  SELECT *, substr(text, 1, low::INT) AS prefix, substr(text, low::INT + 1, (high - low)::INT) AS middle, substr(text, high::INT + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
""",
}
