"""License scans by diagonal voting.

Templates are short license notices and phrases. Every rolling word pair of every text is joined
with the templates' pairs. A match at word i of a text and word j of a template votes for the
diagonal i - j; votes are summed by diagonal, and a diagonal is merged with its neighbours of the next
few words (words put in or left out). The merged votes are verified as a span: they count as far as
they follow each other in the text as in the template, each place once. A span of diagonals d to
d + gap lies within the template's length and gap words of text. It counts if it covers enough of the
template. The join compares the words themselves besides their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, broadcast_parts, saved, with_rolling

#: The base phrases and their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: The method's own templates: usual wordings of license notices and their labels.
TEMPLATES = [
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("dedicated to the public domain", "public-domain"),
]
#: Diagonals up to this far apart are merged; share of a template's pairs that a span must cover.
GAP, COVER = 4, 0.8
#: Template pairs up to which the templates are broadcast.
MOST_BROADCAST = 100_000


def template_table(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row for each word pair: ``template, label, base, seeds, tpos, tw1, tw2`` (seeds: the template's pairs)."""
    rows = []
    for no, (text, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in templates]):
        words = text.split()
        pairs = [(j, *p) for j, p in enumerate(zip(words, words[1:]))]
        rows += [(no, label, is_base, len(pairs), *p) for p in pairs]
    return spark.createDataFrame(rows, "template int, label string, base boolean, seeds int, tpos int, tw1 string, tw2 string")


def _in_order(votes: Column) -> Column:
    """The most of ``votes`` (array of ``pos, tpos``) that follow each other both in the text and in the
    template: the longest increasing run of tpos by pos, by patience sorting. Votes of one pos in descending
    order of tpos can't both be in it."""
    by_place = F.transform(F.array_sort(F.transform(votes, lambda v: F.struct(v["pos"].alias("pos"), (-v["tpos"]).alias("back")))), lambda v: -v["back"])
    none = F.array().cast("array<int>")

    def put(tails: Column, t: Column) -> Column:
        # t takes the place of the first tail that is not below it, or comes last
        above = F.filter(tails, lambda x: x >= t)
        return F.concat(F.filter(tails, lambda x: x < t), F.array(t), F.slice(above, 2, F.greatest(F.size(above), F.lit(1))))

    return F.size(F.aggregate(by_place, none, put))


def scan(docs: DataFrame, templates: DataFrame, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    Words are the runs of digits, letters and non-ASCII characters of the whole text, A-Z
    lower-cased (null: none). n_base: places where a base phrase's words stand; first_word and
    last_word: the smallest and largest start of these, null without any. labels has those of base
    phrases and of templates that a verified span covers to at least ``cover``; score is the largest
    share so covered of any template (a base phrase: 1 where it stands), 0 without a vote. Labels are
    distinct, sorted and joined by commas, "" without any. Repeated rows stay; other columns are
    ignored; no rows, no result.
    """
    # hashed as with_rolling() hashes the pairs of a text
    tpl = broadcast_parts(templates.withColumn("thash", F.xxhash64(F.xxhash64("tw1"), F.xxhash64("tw2"))), ["template", "tpos"], MOST_BROADCAST)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if len(tpl) > 1:
        rows = saved(rows, "texts")  # so that the rows have the same numbers each time
    worded = rows.select("row", "doc_id", alnum_words(ascii_lower(F.col("text"))).alias("words"))
    # the words stay beside the exploded pairs, and are looked at where a hash matches
    paired = with_rolling(worded.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.col("words").alias("again")), "again", [2])
    probes = paired.select("row", "doc_id", "n_words", "words", F.posexplode_outer("rolling_2").alias("pos", "hash"))
    same = (F.col("hash") == F.col("thash")) & (F.get("words", F.col("pos")) == F.col("tw1")) & (F.get("words", F.col("pos") + 1) == F.col("tw2"))
    # the first pair, or none, stands for a text without a match, so that one pass gives these too
    votes = None
    for part in tpl:
        found = probes.join(part, same, "left").where("pos is null or pos = 0 or template is not null").select(
            "row", "doc_id", "n_words", "template", "label", "base", "seeds", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        votes = found if votes is None else votes.unionByName(found)
    votes = votes.repartition("row")  # all that follows is by text, so it is the only exchange
    diagonals = votes.groupBy("row", "template", "label", "base", "seeds", "diagonal").agg(
        F.collect_set("tpos").alias("covered"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words")
    ).withColumn("place", F.coalesce(F.col("base") & (F.size("covered") == F.col("seeds")), F.lit(False)))
    # each diagonal with its neighbours of the next ``gap`` words: gap + 1 sets of the template's length at most
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, gap)
    merged = diagonals.withColumn("spans", F.collect_list(F.struct("diagonal", "covered")).over(near))
    span = F.flatten(F.transform("spans", lambda s: F.transform(s["covered"], lambda t: F.struct((s["diagonal"] + t).alias("pos"), t.alias("tpos")))))
    # the votes of one diagonal are in order already
    covered = F.when(F.size("spans") == 1, F.size("covered")).otherwise(_in_order(span))
    share = F.when(F.col("template").isNull(), F.lit(0.0)).when(F.col("base"), F.col("place").cast("double")).otherwise(covered / F.col("seeds"))
    shared = merged.select("row", "doc_id", "n_words", "label", "base", "place", "diagonal", share.alias("share"))
    at = F.when(F.col("place"), F.col("diagonal")).cast("long")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return shared.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum(F.col("place").cast("long")).alias("n_base"),
        F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("place") | (~F.col("base") & (F.col("share") >= cover)), F.col("label"))).alias("labels"),
        F.max("share").alias("score"),
    ).drop("row")
