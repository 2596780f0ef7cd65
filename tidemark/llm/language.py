"""Language identification by Bayesian fusion of evidence.

A text gives log likelihoods under hashed letter-trigram models and under a uniform model for
writing in no known language ("und"). They are combined with the likelihoods of the declared markup
language and of the address's suffix and with a prior of the host, all estimated by grouped sums of
the text's own posteriors. The host's prior is smoothed towards that of its domain and this towards
that of all rows; a row's own share is left out of its host's sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, saved, unused

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BUCKETS = 1 << 16
#: Labelled texts of each language that a model is trained on (those with the smallest hashes of
#: their key), and partitions that count them.
SAMPLE, SAMPLE_PARTS = 1500, 8
#: Weight of a trigram's log likelihood (three cover a letter), pseudo-rows of a parent prior.
TEMPER, KAPPA = 1 / 3, 20.0
LEAST_POSTERIOR = 0.5


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each letter trigram of a whole text: lower-cased, ASCII other than letters a space,
    spaces collapsed. None without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 0xC0)
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, raw, 32).astype(np.uint32)
    c = c[letter | np.concatenate(([True], letter[:-1]))]
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    mixed = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)


def train(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log probabilities, a row for each language and a last one for none, from ``texts (key, text,
    language)``. Rows of other languages, or null, are not used; a null key is a key like any other, a null
    text has no trigrams. Of repeated rows each counts. Without any row all trigrams are as likely."""
    known = texts.where(F.col("language").isin(*languages))
    counts = {r[0]: r[1] for r in known.groupBy("language").count().collect()}  # as many as languages
    hashed = F.xxhash64("key").cast("double")
    wanted = F.lit(False)
    for name, n in counts.items():
        wanted = wanted | ((F.col("language") == name) & (hashed < -(2.0**63) + 2.0**64 * min(1.0, SAMPLE / n)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for name, text in zip(b["language"], b["text"]):
                total[languages.index(name)] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield pd.DataFrame({"total": [total.tobytes()]})

    rows = known.where(wanted).select("language", "text").repartition(SAMPLE_PARTS).mapInPandas(count, "total binary").collect()
    total = sum((np.frombuffer(r[0], np.int64).reshape(len(languages), BUCKETS) for r in rows), np.zeros((len(languages), BUCKETS), np.int64))
    smooth = total + 0.1
    model = np.log(smooth / smooth.sum(1, keepdims=True))
    return np.vstack([model, np.full((1, BUCKETS), -math.log(BUCKETS))]).astype(np.float32)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([a-z]+)$", 1)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def declared_language(html: Column) -> Column:
    """The primary tag of ``<html lang=...>``, null without one (a null page too)."""
    tag = F.regexp_extract(html, r"(?i)<html(\s[^>]*)", 1)
    return F.nullif(F.lower(F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def identify(rows: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """``rows`` without ``text``, with ``language, posterior, kept`` added.

    ``rows`` has ``text, host, declared`` and any other columns, whatever their names; those of the three
    names added are replaced. Texts are scored whole. Null host and declared are no evidence; a text
    without letters (null, empty) is "und" with posterior 1. kept: the language is known and its
    posterior is at least ``least_posterior``. Ties go to the first language. Repeated rows stay; an
    empty table gives none.
    """
    names = [*languages, UNKNOWN]
    k = len(names)
    # evidence is worked out beside the rows, which wait in one column under a name of their own
    (carried,) = unused(["host", "declared", "text"], "carried")
    rest = columns_of(rows, ("text", "language", "posterior", "kept"))
    rows = rows.select("host", "declared", "text", F.struct(*rest).alias(carried))

    @F.arrow_udf("array<double>")
    def likelihoods(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:  # one at a time, so that a batch's texts are not held twice
            b = trigrams(t.as_py())
            out.append(model[:, b].sum(1, dtype=np.float64) * TEMPER if len(b) else np.zeros(0))
        return pa.array(out, pa.list_(pa.float64()))

    got = saved(rows.select("host", "declared", carried, likelihoods("text").alias("__ll")), "likelihoods")
    ll = [F.get("__ll", i) for i in range(k)]
    top = F.array_max("__ll")
    weight = [F.exp(x - top) for x in ll]
    own = sum(weight[1:], weight[0])
    scored = got.withColumns({f"__p{i}": F.coalesce(w / own, F.lit(0.0)) for i, w in enumerate(weight)})
    domain = domain_of(F.col("host"))
    scored = scored.withColumns({"__domain": domain, "__suffix": F.nullif(suffix_of(F.col("host")), F.lit(""))})

    def sums(key: str, tag: str) -> DataFrame:
        by = scored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{tag}"))
        return by.agg(*[F.sum(f"__p{i}").alias(f"__{tag}{i}") for i in range(k)])

    totals = [x or 0.0 for x in scored.agg(*[F.sum(f"__p{i}") for i in range(k)]).first()]
    base = [(x + 1.0) / (sum(totals) + k) for x in totals]
    hosts = scored.where(F.col("host").isNotNull()).groupBy(F.col("host").alias("__kh"), F.col("__domain").alias("__kd")).agg(
        *[F.sum(f"__p{i}").alias(f"__h{i}") for i in range(k)]
    )
    domains = hosts.groupBy("__kd").agg(*[F.sum(f"__h{i}").alias(f"__d{i}") for i in range(k)])
    table = saved(hosts.join(domains, "__kd").drop("__kd"), "hosts")  # sums of a domain include its hosts'
    suffixes, declared = saved(sums("__suffix", "s"), "suffixes"), saved(sums("declared", "m"), "declared")
    n_suffixes, n_declared = suffixes.count(), declared.count()
    all_s = suffixes.agg(*[F.sum(f"__s{i}") for i in range(k)]).first()
    all_m = declared.agg(*[F.sum(f"__m{i}") for i in range(k)]).first()

    joined = (
        scored.join(table, F.col("host") == F.col("__kh"), "left")
        .join(suffixes, F.col("__suffix") == F.col("__ks"), "left")
        .join(declared, F.col("declared") == F.col("__km"), "left")
    )
    zero = F.lit(0.0)
    less = lambda c, i: F.greatest(F.coalesce(F.col(f"__{c}{i}"), zero) - F.col(f"__p{i}"), zero)  # noqa: E731  without the row itself
    n_domain = sum((less("d", i) for i in range(1, k)), less("d", 0))
    n_host = sum((less("h", i) for i in range(1, k)), less("h", 0))
    logs = []
    for i in range(k):
        of_domain = (less("d", i) + KAPPA * base[i]) / (n_domain + KAPPA)
        of_host = (less("h", i) + KAPPA * of_domain) / (n_host + KAPPA)
        log = ll[i] + F.log(of_host)
        for tag, n, total in (("s", n_suffixes, all_s), ("m", n_declared, all_m)):
            here = (less(tag, i) + 0.5) / ((total[i] or 0.0) + 0.5 * max(1, n))
            log = log + F.when(F.col(f"__k{tag}").isNotNull(), F.log(here)).otherwise(zero)
        logs.append(log)
    fused = joined.select(carried, F.array(*logs).alias("__log"), (F.size("__ll") == 0).alias("__none"))
    best = F.array_max("__log")
    mass = F.aggregate("__log", zero, lambda a, x: a + F.exp(x - best))
    place = F.array_position("__log", best)
    named = fused.select(
        carried,
        F.when(F.col("__none"), F.lit(UNKNOWN)).otherwise(F.element_at(F.array(*map(F.lit, names)), place.cast("int"))).alias("language"),
        F.when(F.col("__none"), 1.0).otherwise(1.0 / mass).alias("posterior"),
    )
    kept = (F.col("language") != UNKNOWN) & (F.col("posterior") >= least_posterior)
    return named.select(carried, "language", "posterior", kept.alias("kept")).select(f"{carried}.*", "language", "posterior", "kept")


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows for identify() from documents: the source stands for the host, nothing is declared. Nulls stay
    nulls and repeated rows stay; other columns than doc_id, source and text are left out."""
    return docs.select("doc_id", F.col("source").alias("host"), F.lit(None).cast("string").alias("declared"), "text")


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows for identify() from raw pages: host and declared language from URL and markup. A null or
    malformed URL has no host, a null page no text; other columns than page_id, url and html are left out."""
    host = F.nullif(F.regexp_extract(ascii_lower(F.coalesce("url", F.lit(""))), r"\A[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    return pages.select("page_id", host.alias("host"), declared_language(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("text"))


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that identify() doesn't keep. Trained on a bounded sample of ``docs`` by
    their column ``lang``; a table without known languages (an empty one too) has nothing to reject by and
    stays whole. Texts without letters (null, empty) go. A text of a doc_id, or of a null one, goes or stays
    with its repeated rows; columns stay as they were, whatever their names."""
    if not docs.where(F.col("lang").isin(*LANGUAGES)).take(1):
        return docs
    model = train(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("language")))
    rows = document_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    g_id, g_hash, own_hash = unused(docs.columns, "g_id", "g_hash", "own_hash")
    gone = identify(rows, model).where("not kept").select(F.col("doc_id").alias(g_id), F.col("text_hash").alias(g_hash)).distinct()
    ready = docs.select(*columns_of(docs), F.xxhash64("text").alias(own_hash))
    kept = ready.join(gone, (F.col(own_hash) == F.col(g_hash)) & F.col("doc_id").eqNullSafe(F.col(g_id)), "left_anti")
    return kept.select(*columns_of(docs))
