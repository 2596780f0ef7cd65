"""Nested market documents: flattening, block expansion, audits. Periods are rows ``period_id, ts_uid,
sequence, curve_type, start, end, resolution`` and points rows ``period_id, position, value``."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import scan

DOCUMENT_SCHEMA = (
    "mRID string, TimeSeries array<struct<mRID: string, curveType: string, `classificationSequence_AttributeInstanceComponent.position`: int, "
    "Period: array<struct<timeInterval: struct<start: string, end: string>, resolution: string, Point: array<struct<position: int, `price.amount`: double, quantity: double>>>>>>"
)


def minutes_of(resolution: Column) -> Column:
    return F.when(resolution == "PT15M", 15).when(resolution == "PT30M", 30).when(resolution.isin("PT60M", "PT1H"), 60)


def instant(text: str) -> Column:
    """A time of a document, with or without seconds; null if malformed."""
    return F.coalesce(F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(F.col(text)))


def flatten(documents: DataFrame, column: str = "xml") -> DataFrame:
    """A row for each point of each document; namespaces do not matter."""
    parsed = documents.withColumn("d", F.from_xml(column, DOCUMENT_SCHEMA)).select("*", F.posexplode("d.TimeSeries").alias("ts_index", "t")).drop("d", column)
    periods = parsed.select("*", F.posexplode("t.Period").alias("period_index", "p"))
    sequence = F.col("t")["classificationSequence_AttributeInstanceComponent.position"]
    flat = periods.select(*[c for c in documents.columns if c != column], "ts_index", "period_index", F.col("t.mRID").alias("ts_uid"), F.col("t.curveType").alias("curve_type"), sequence.alias("sequence"),
                          instant("p.timeInterval.start").alias("start"), instant("p.timeInterval.end").alias("end"), F.col("p.resolution").alias("resolution"), F.explode("p.Point").alias("q"))
    return flat.select("*", F.col("q.position").alias("position"), F.coalesce(F.col("q")["price.amount"], F.col("q.quantity")).alias("value")).drop("q")


def geometry(periods: DataFrame) -> DataFrame:
    """Minutes and number of positions of each period."""
    m = minutes_of(F.col("resolution"))
    return periods.withColumn("minutes", m).withColumn("n_positions", ((F.unix_timestamp("end") - F.unix_timestamp("start")) / (m * 60)).cast("int"))


def expand_blocks(periods: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each interval. A03: positions between published ones carry the last value on and are
    marked synthesized. Other curve types: published points only."""
    shaped = geometry(periods)
    joined = points.join(shaped, "period_id")
    nxt = F.lead("position").over(Window.partitionBy("period_id").orderBy("position"))
    to = F.when(F.col("curve_type") == "A03", F.coalesce(nxt - 1, F.col("n_positions"))).otherwise(F.col("position"))
    rows = joined.withColumn("to", to).withColumn("at", F.explode(F.sequence("position", F.greatest("position", "to"))))
    ts = F.timestamp_seconds(F.unix_timestamp("start") + (F.col("at") - 1) * F.col("minutes") * 60)
    return rows.select("period_id", "ts_uid", "sequence", "curve_type", "minutes", F.col("at").alias("position"), ts.alias("timestamp_utc"), "value", (F.col("at") != F.col("position")).alias("is_synthesized"))


def point_violations(periods: DataFrame, points: DataFrame) -> DataFrame:
    """Bad geometry and bad points by period and rule."""
    shaped = geometry(periods)
    agg = points.groupBy("period_id").agg(
        F.count("*").alias("n"), F.count_distinct("position").alias("nd"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.sum(F.col("value").isNull().cast("int")).alias("nulls")
    )
    both = shaped.join(agg, "period_id", "left")
    rules = {
        "geometry": "minutes is null or end <= start or (unix_timestamp(end) - unix_timestamp(start)) % (minutes * 60) <> 0",
        "no_points": "n is null", "duplicate_position": "n > nd", "out_of_range": "lo < 1 or hi > n_positions", "null_value": "nulls > 0",
        "a01_hole": "curve_type = 'A01' and nd < n_positions", "a03_start": "curve_type = 'A03' and lo <> 1", "unknown_curve": "coalesce(curve_type, '') not in ('A01', 'A02', 'A03')",
    }
    hit = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return both.select("period_id", F.explode(hit).alias("rule"))


def period_gaps(periods: DataFrame, long: bool = False) -> DataFrame:
    """Gap and overlap of each period against the furthest end before it in its series (``frontier``). With ``long`` a
    series is cut over many tasks (see scan)."""
    if long:
        periods = scan.with_prefix(periods, ["ts_uid"], ["start", "end"], {"__front": scan.running_max("end")}, own=False)
        return _against(periods, F.col("__front")).drop("__front")
    return _against(periods, F.max("end").over(Window.partitionBy("ts_uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)))


def _against(periods: DataFrame, front: Column) -> DataFrame:
    return periods.withColumns({"frontier": front, "gap": F.coalesce(F.col("start") > front, F.lit(False)), "overlap": F.coalesce(F.col("start") < front, F.lit(False))})


def curve_summary(points: DataFrame, periods: DataFrame, year: Column) -> DataFrame:
    """Per year, minutes and curve type: points, explicit, synthesized and their share, with periods."""
    by = ["year", "minutes", "curve_type"]
    p = points.withColumn("year", year).groupBy(*by).agg(F.count("*").alias("n_points"), F.sum(F.col("is_synthesized").cast("long")).alias("n_synthesized"))
    s = geometry(periods).withColumn("year", F.year("start")).groupBy(*by).agg(F.count("*").alias("n_periods"), F.count_distinct("ts_uid").alias("n_series"))
    on = [p[k].eqNullSafe(s[k]) for k in by]
    out = p.join(s, on, "full").select(*[F.coalesce(p[k], s[k]).alias(k) for k in by], "n_points", "n_synthesized", "n_periods", "n_series")
    return out.withColumn("pct_synthesized", F.col("n_synthesized") / F.col("n_points") * 100)


def curve_types_before(periods: DataFrame, cutover: Column, minutes: int = 60) -> DataFrame:
    """The distinct curve types of periods of ``minutes`` that start before ``cutover``, sorted."""
    return geometry(periods).where((F.col("start") < cutover) & (F.col("minutes") == minutes)).select("curve_type").distinct().orderBy("curve_type")


def series_shape(points: DataFrame, start: Column, end: Column, first: int = 4) -> DataFrame:
    """Series that overlap a window: curve types and sequences, point counts, resolutions and first points."""
    rows = points.where((F.col("timestamp_utc") >= start) & (F.col("timestamp_utc") < end))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("ts_uid").orderBy("timestamp_utc")))
    head = F.sort_array(F.collect_list(F.when(F.col("rn") <= first, F.struct("timestamp_utc", "value"))))
    told = lambda c: F.sort_array(F.collect_set(c))  # noqa: E731  a few values a series
    return ranked.groupBy("ts_uid").agg(F.count("*").alias("n_points"), told("curve_type").alias("curve_types"), told("sequence").alias("sequences"), told("minutes").alias("resolutions"), head.alias("first_points"))


#: Fields of documents: where they stand (null index: of the document itself), the names above them, and their text.
FIELDS = "array<struct<ts_index: int, place: int, path: string, text: string>>"


def _leaves(element: ET.Element, above: str) -> list[tuple[str, str]]:
    """Paths and texts of the elements without children, in the order of the document, whatever their names."""
    name = element.tag.rpartition("}")[2]
    path = f"{above}.{name}" if above else name
    if len(element):
        return [x for child in element for x in _leaves(child, path)]
    text = (element.text or "").strip()
    return [(path, text)] if text else []


def _fields_of(xml: str | None, series: str, leave: tuple[str, ...]) -> list[dict] | None:
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        root = None
    if root is None:
        return None
    out, index = [], 0
    for child in root:
        whole = child.tag.rpartition("}")[2] != series
        found = _leaves(child, "") if whole else [x for c in child if c.tag.rpartition("}")[2] not in leave for x in _leaves(c, "")]
        out += [{"ts_index": None if whole else index, "path": p, "text": t} for p, t in found]
        index += not whole
    return [x | {"place": n} for n, x in enumerate(out)]


def document_fields(xml: Column, series: str = "TimeSeries", leave: tuple[str, ...] = ("Period",)) -> Column:
    """The fields of a document as FIELDS, by no schema: each element without children and with a text, repeats kept in
    order, namespaces and attributes left out. Fields of the document's ``series`` elements carry that element's number;
    what is within their children ``leave`` is left out. Null if the document is null or no XML. An Arrow batch of
    documents at a time: Spark's own reader needs a schema, and cannot read XML as a variant in generated code."""

    @arrow_udf(FIELDS)
    def fields(documents: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("ts_index", pa.int32()), ("place", pa.int32()), ("path", pa.string()), ("text", pa.string())]))
        return pa.array([_fields_of(x, series, leave) for x in documents.to_pylist()], kind)

    return fields(xml)


def flatten_fields(documents: DataFrame, keys: list[str], column: str = "xml") -> DataFrame:
    """``*keys, ts_index, place, path, text``: a row for each field of each document and of its series but their periods."""
    return documents.select(*keys, F.explode(document_fields(F.col(column))).alias("f")).select(*keys, "f.*")


def paths(documents: DataFrame, keys: list[str], column: str = "xml", day: tuple[Column, Column] | None = None, resolution: str = "PT15M") -> DataFrame:
    """``*keys, ts_index, sequence, place, path, text``: a row for each field of each document's series but its periods,
    repeats kept in order, whatever the fields' names. With ``day (start, end)`` only series of which a period of
    ``resolution`` overlaps it; periods without both boundaries don't. Series of a document whose sequence is not 1 or 2
    are left out."""
    sequence = "classificationSequence_AttributeInstanceComponent.position"
    parsed = documents.select(*keys, F.from_xml(column, DOCUMENT_SCHEMA).alias("d"), document_fields(F.col(column)).alias("fields"))
    # outer, whose null rows the sequence drops: for an inner one the optimizer infers a filter on the parsed document and pushes it
    # below what makes the documents, where it parses one for each of their rows
    rows = parsed.select(*keys, "fields", F.posexplode_outer("d.TimeSeries").alias("ts_index", "t")).withColumn("sequence", F.col("t")[sequence]).where("sequence in (1, 2)")
    if day is not None:
        lo, hi = day
        at = lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(c))
        fits = lambda p: F.coalesce((p["resolution"] == resolution) & (at(p["timeInterval"]["start"]) < hi) & (at(p["timeInterval"]["end"]) > lo), F.lit(False))
        rows = rows.where(F.exists("t.Period", fits))
    own = F.filter("fields", lambda f: f["ts_index"] == F.col("ts_index"))
    return rows.select(*keys, "ts_index", "sequence", F.explode(own).alias("f")).select(*keys, "ts_index", "sequence", "f.place", "f.path", "f.text")


def field_diff(fields: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, path, texts_a, texts_b`` of paths(): the fields whose lists of texts, in order, differ between sequence 1
    (a) and 2 (b) of a document, but for the sequence itself; an empty list where a side lacks the field. Documents
    of which a sequence has several series are ambiguous and have no rows, nor have those with one sequence alone. A
    document's fields are few and meet in one group."""
    of = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col("sequence") == n, F.struct("place", "text")))), lambda x: x["text"])
    count = lambda n: F.count_distinct(F.when(F.col("sequence") == n, F.col("ts_index")))
    clear = fields.groupBy(*keys).agg(count(1).alias("__a"), count(2).alias("__b")).where("__a = 1 and __b = 1").select(*keys)
    told = fields.where("path not like 'classificationSequence%'").join(clear, keys, "left_semi")
    return told.groupBy(*keys, "path").agg(of(1).alias("texts_a"), of(2).alias("texts_b")).where("texts_a <> texts_b")


def sequence_diff(fields: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, path, text, n_a, n_b`` of paths() whose counts differ between sequence 1 (a) and 2 (b), but for the
    sequence itself. Documents of which a sequence has several series are ambiguous: one row with path null and
    their numbers of series, and no difference is told. Documents with one sequence alone have no rows."""
    by = F.sum(F.when(F.col("sequence") == 1, 1).otherwise(0)), F.sum(F.when(F.col("sequence") == 2, 1).otherwise(0))
    series = fields.select(*keys, "ts_index", "sequence").distinct().groupBy(*keys).agg(by[0].alias("n_a"), by[1].alias("n_b"))
    none = F.lit(None).cast("string")
    unclear = series.where("n_a > 1 or n_b > 1").select(*keys, none.alias("path"), none.alias("text"), "n_a", "n_b")
    clear = fields.join(series.where("n_a = 1 and n_b = 1").select(*keys), keys, "left_semi").where("path not like 'classificationSequence%'")
    return clear.groupBy(*keys, "path", "text").agg(by[0].alias("n_a"), by[1].alias("n_b")).where("n_a <> n_b").unionByName(unclear)


def attribute_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``path, text`` rows of two documents as multisets: what differs, with both counts."""
    both = a.select("path", "text", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("path", "text", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("path", "text").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where("n_a <> n_b")


def selection_effect(rows: DataFrame, cutover: Column) -> DataFrame:
    """``stage, post, n_keys, n_rows``: times with several rows before and after select_sequence(), on either side
    of ``cutover``. Both stages are counted in one grouping."""
    kept = F.coalesce((F.col("sequence") == 1), F.lit(True))
    n = rows.groupBy("timestamp_utc").agg(F.count("*").alias("before"), F.sum(kept.cast("long")).alias("after"))
    long = n.unpivot(["timestamp_utc"], ["before", "after"], "stage", "n").where("n > 1")
    return long.groupBy("stage", (F.col("timestamp_utc") >= cutover).alias("post")).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


#: Times on which two sequences differ by more; shares of classified times that decide for a sequence.
PRICE_TOLERANCE, CLEAR, RARE = 0.01, 0.95, 0.05


def compare_sequences(first: DataFrame, second: DataFrame, value: str = "price", tol: float = PRICE_TOLERANCE) -> DataFrame:
    """``timestamp_utc, price_seq1, price_seq2, diff, coverage, disagrees`` for each time of either: coverage is
    both, seq1_only or seq2_only. A time that a sequence has twice is a ValueError."""
    both = first.select("timestamp_utc", F.lit(1).alias("s"), F.col(value).alias("v")).unionByName(second.select("timestamp_utc", F.lit(2).alias("s"), F.col(value).alias("v")))
    made = both.groupBy("timestamp_utc").agg(
        *[F.max(F.when(F.col("s") == i, F.col("v"))).alias(f"price_seq{i}") for i in (1, 2)], *[F.count(F.when(F.col("s") == i, 1)).alias(f"__n{i}") for i in (1, 2)]
    )
    if made.where("__n1 > 1 or __n2 > 1").take(1):
        raise ValueError("a sequence has a time twice")
    diff = F.abs(F.col("price_seq1") - F.col("price_seq2"))
    coverage = F.when(F.col("price_seq2").isNull(), "seq1_only").when(F.col("price_seq1").isNull(), "seq2_only").otherwise("both")
    return made.select("timestamp_utc", "price_seq1", "price_seq2", diff.alias("diff"), coverage.alias("coverage"), F.coalesce(diff > tol, F.lit(False)).alias("disagrees"))


def sequence_coverage(compared: DataFrame) -> DataFrame:
    """``n_both, n_seq1_only, n_seq2_only, n_disagree`` of compare_sequences()."""
    count = lambda c: F.sum((F.col("coverage") == c).cast("long"))
    return compared.agg(count("both").alias("n_both"), count("seq1_only").alias("n_seq1_only"), count("seq2_only").alias("n_seq2_only"), F.sum(F.col("disagrees").cast("long")).alias("n_disagree"))


def reference_verdict(matches: DataFrame, column: str = "match") -> DataFrame:
    """``n_seq1, n_seq2, n_neither, n_both, n_no_data, verdict`` of times told by columns.classify_match(): a
    sequence is confirmed if it alone matches more than 95 % and the other alone less than 5 % of the times that
    match the first, the second or neither; "nothing" without any of these, else "mixed"."""
    names = ("seq1", "seq2", "neither", "both", "no_data")
    counted = matches.agg(*[F.coalesce(F.sum((F.col(column) == n).cast("long")), F.lit(0)).alias(f"n_{n}") for n in names])
    all_ = F.col("n_seq1") + F.col("n_seq2") + F.col("n_neither")
    clear = lambda a, b: (F.col(a) > CLEAR * all_) & (F.col(b) < RARE * all_)
    verdict = F.when(all_ == 0, "nothing").when(clear("n_seq1", "n_seq2"), "seq1").when(clear("n_seq2", "n_seq1"), "seq2").otherwise("mixed")
    return counted.withColumn("verdict", verdict)


def select_sequence(df: DataFrame) -> DataFrame:
    return df.where("sequence is null or sequence = 1").drop("sequence")


def select_resolution(df: DataFrame, cutover: Column) -> DataFrame:
    """60-minute rows before the cutover, 15-minute rows from it on."""
    t = F.col("timestamp_utc")
    return df.where(((t < cutover) & (F.col("resolution_min") == 60)) | ((t >= cutover) & (F.col("resolution_min") == 15)))


def duplicate_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with several rows: rows, distinct values, range, and whether the values agree."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.where("n > 1").withColumn("identical", F.col("n_values") <= 1)


def duplicate_split(profile: DataFrame) -> DataFrame:
    """``grouping_key, level, n_keys, n_rows, n_identical, n_different`` of duplicate_profile(): by year, by minute of
    the hour, and overall (level null)."""
    levels = F.array(
        F.struct(F.lit("overall").alias("grouping_key"), F.lit(None).cast("int").alias("level")),
        *[F.struct(F.lit(k).alias("grouping_key"), f("timestamp_utc").alias("level")) for k, f in (("year", F.year), ("minute", F.minute))],
    )
    long = profile.select("n", "identical", F.explode(levels).alias("k"))
    same = F.col("identical").cast("long")
    return long.groupBy("k.grouping_key", "k.level").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"), F.sum(same).alias("n_identical"), F.sum(1 - same).alias("n_different"))
