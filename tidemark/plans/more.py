"""More registered queries: documents made from ``events``, outputs written and read back, joins, folds, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.streaming import sequential
from tidemark.functions import columns as fn
from tidemark.operators import checks, decisions, forecast, joins, metrics, reports, splits, timeseries, uncertainty
from tidemark.operators import documents as docs
from tidemark.sources import tables
from tidemark.sources.tables import saved

from . import adapters as ad
from .registry import _CALSQL, _CAL, _DAYS, _LONG, _METRIC, KEY, ROWS, _scored, register, ts

B = ad.berlin

# --- documents: a period for each series and day, a point for each hour with events -----------------
#: Series of curve type A03 and A01 (others A02), and the sequence of some series.
A03, A01, SEQUENCES = ("purchase", "view"), ("click",), {"purchase": 1, "click": 1, "view": 2}
PER = f"""{ad.A1},
pt AS (SELECT series_id || '/' || strftime(t, '%Y-%m-%d') AS period_id, series_id, t, hour(t) + 1 AS position, price AS value FROM a1),
per AS (SELECT DISTINCT period_id, series_id AS ts_uid, date_trunc('day', t)::TIMESTAMP AS s, date_trunc('day', t)::TIMESTAMP + INTERVAL 1 DAY AS e,
  CASE WHEN series_id IN {A03} THEN 'A03' WHEN series_id = 'click' THEN 'A01' ELSE 'A02' END AS ct,
  CASE series_id WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS sequence FROM pt)"""
BLK = f"""{PER},
blk AS (SELECT per.*, position, value, CASE WHEN ct = 'A03' THEN coalesce(lead(position) OVER (PARTITION BY period_id ORDER BY position) - 1, 24) ELSE position END AS till FROM pt JOIN per USING (period_id)),
spread AS (SELECT *, unnest(generate_series(position, till)) AS place FROM blk),
ex AS (SELECT *, s + to_hours(place::BIGINT - 1) AS t FROM spread)"""


def _points(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    day = F.date_trunc("day", "timestamp_utc")
    rows = ad.a1(s, d).withColumn("period_id", F.concat("series_id", F.lit("/"), F.date_format("timestamp_utc", "yyyy-MM-dd")))
    uid = F.col("series_id")
    curve = F.when(uid.isin(*A03), "A03").when(uid.isin(*A01), "A01").otherwise("A02")
    sequence = F.create_map(*[F.lit(x) for kv in SEQUENCES.items() for x in kv])[uid]
    periods = rows.select("period_id", uid.alias("ts_uid"), sequence.alias("sequence"), curve.alias("curve_type"), day.alias("start"), (day + F.expr("interval 1 day")).alias("end"), F.lit("PT60M").alias("resolution")).distinct()
    return periods, rows.select("period_id", (F.hour("timestamp_utc") + 1).alias("position"), F.col("price").alias("value"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    periods, points = _points(s, d)
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v.cast("string"), F.lit(f"</{n}>"))
    point = F.concat(F.lit("<Point>"), tag("position", F.col("position")), tag("price.amount", F.col("value")), F.lit("</Point>"))
    body = points.groupBy("period_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", point.alias("x")))), lambda p: p["x"]), "").alias("points"))  # 24 at most
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")
    span = F.concat(F.lit("<timeInterval>"), tag("start", when("start")), tag("end", when("end")), F.lit("</timeInterval>"))
    period = F.concat(F.lit("<Period>"), span, tag("resolution", F.col("resolution")), F.col("points"), F.lit("</Period>"))
    return periods.join(body, "period_id").select("period_id", F.concat(F.lit("<Doc><TimeSeries>"), tag("mRID", F.col("ts_uid")), tag("curveType", F.col("curve_type")), period, F.lit("</TimeSeries></Doc>")).alias("xml"))


register("src_document_flatten", "period_id:s ts_uid:s curve_type:s start:t end:t resolution:s position:i value:f", lambda s, d: docs.flatten(_documents(s, d)),
         f"{PER} ;; SELECT period_id, ts_uid, ct AS curve_type, s AS start, e AS \"end\", 'PT60M' AS resolution, position, value FROM per JOIN pt USING (period_id)")
register("dec_period_geometry", "period_id:s minutes:i n_positions:i", lambda s, d: docs.geometry(_points(s, d)[0]), f"{PER} ;; SELECT period_id, 60 AS minutes, "
    f"24 AS n_positions FROM per")
register("dec_block_expand", "period_id:s curve_type:s position:i timestamp_utc:t value:f is_synthesized:b", lambda s, d: docs.expand_blocks(*_points(s, d)),
         f"{BLK} ;; SELECT period_id, ct AS curve_type, place AS position, t AS timestamp_utc, value, place <> position AS is_synthesized FROM ex")
register("dec_point_validation", "period_id:s rule:s", lambda s, d: docs.point_violations(*_points(s, d)),
         f"{PER}, g AS (SELECT period_id, ct, count(*) AS n, min(position) AS lo FROM per JOIN pt USING (period_id) GROUP BY 1, 2) ;; SELECT period_id, "
         f"'a01_hole' AS rule FROM g WHERE ct = 'A01' AND n < 24 UNION ALL SELECT period_id, 'a03_start' FROM g WHERE ct = 'A03' AND lo <> 1")
_SPAN = "sp AS (SELECT DISTINCT event_type AS ts_uid, date_trunc('hour', ts)::TIMESTAMP AS s, date_trunc('hour', ts)::TIMESTAMP + to_hours(1 + event_id % 3) AS e FROM events), fr AS (SELECT *, max(e) OVER (PARTITION BY ts_uid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM sp)"


def _spans(s: SparkSession, d: str, long: bool = False) -> DataFrame:
    start = F.date_trunc("hour", "ts")
    end = F.timestamp_seconds(F.unix_timestamp(start) + (1 + F.col("event_id") % 3) * 3600)
    rows = ad.events(s, d).select(F.col("event_type").alias("ts_uid"), start.alias("start"), end.alias("end")).distinct()
    return docs.period_gaps(saved(rows) if long else rows, long)


register("aud_period_gaps", "ts_uid:s start:t end:t gap:b overlap:b", _spans, f"{_SPAN} ;; SELECT ts_uid, s AS start, e AS \"end\", coalesce(s > front, false) AS gap, coalesce(s < front, false) AS overlap FROM fr")
register("win_frontier", "ts_uid:s start:t end:t frontier:t", _spans, f"{_SPAN} ;; SELECT ts_uid, s AS start, e AS \"end\", front AS frontier FROM fr")
register("aud_curve_summary", "year:i minutes:i curve_type:s n_points:i n_synthesized:i n_periods:i n_series:i pct_synthesized:f",
         lambda s, d: docs.curve_summary(docs.expand_blocks(*_points(s, d)), _points(s, d)[0], F.year("timestamp_utc")),
         f"{BLK}, p AS (SELECT year(t) AS year, ct, count(*) AS n_points, count(*) FILTER (place <> position) AS n_syn FROM ex GROUP BY 1, 2), q "
         f"AS (SELECT year(s) AS year, ct, count(*) AS n_periods, count(DISTINCT ts_uid) AS n_series FROM per GROUP BY 1, 2) ;; SELECT year, 60 AS minutes, "
         f"ct AS curve_type, n_points, n_syn AS n_synthesized, n_periods, n_series, 100.0 * n_syn / n_points AS pct_synthesized FROM p FULL JOIN q USING (year, ct)")
register("aud_curve_types_before", "curve_type:s", lambda s, d: docs.curve_types_before(_points(s, d)[0], ts("2024-01-14 23:00:00")),
         f"{PER} ;; SELECT DISTINCT ct AS curve_type FROM per WHERE s < TIMESTAMP '2024-01-14 23:00:00' ORDER BY 1")
register("aud_series_shape", "ts_uid:s n_points:i curve_type:s sequence:i minutes:i n_first:i first_value:f last_value:f",
         lambda s, d: docs.series_shape(docs.expand_blocks(*_points(s, d)), ts("2024-01-10"), ts("2024-01-12")).select("ts_uid", "n_points", F.get("curve_types", 0).alias("curve_type"), F.get("sequences", 0).alias("sequence"), F.get("resolutions", 0).alias("minutes"), F.size("first_points").alias("n_first"), F.element_at("first_points", 1)["value"].alias("first_value"), F.element_at("first_points", -1)["value"].alias("last_value")),
         f"{BLK}, r AS (SELECT *, row_number() OVER (PARTITION BY ts_uid ORDER BY t) AS rn FROM ex WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-12') "
         f";; SELECT ts_uid, count(*) AS n_points, min(ct) AS curve_type, min(sequence) AS sequence, 60 AS minutes, count(*) FILTER (rn <= 4) AS n_first, "
         f"arg_min(value, rn) AS first_value, arg_max(value, rn) FILTER (rn <= 4) AS last_value FROM r GROUP BY 1")


def _paths(s: SparkSession, d: str, odd: int) -> DataFrame:
    return ad.events(s, d).where(F.col("event_id") % 2 == odd).select(F.col("event_type").alias("path"), F.date_format("ts", "yyyy-MM-dd HH").alias("text"))


register("aud_attribute_diff", "path:s text:s n_a:i n_b:i", lambda s, d: docs.attribute_diff(_paths(s, d, 1), _paths(s, d, 0)),
         "SELECT event_type AS path, strftime(ts, '%Y-%m-%d %H') AS text, count(*) FILTER (event_id % 2 = 1) AS n_a, count(*) FILTER (event_id % 2 = 0) AS n_b "
         "FROM events GROUP BY 1, 2 HAVING n_a <> n_b")


def _sequence_documents(s: SparkSession, d: str) -> DataFrame:
    """A document a day with two series, one of each sequence; their fields differ by the day, on every fifth day
    the second is there twice, and on every seventh its periods have another resolution."""
    days = ad.events(s, d).select(F.to_date("ts").alias("day")).distinct()
    n = F.dayofmonth("day")
    tag = lambda t, v: F.concat(F.lit(f"<{t}>"), v.cast("string"), F.lit(f"</{t}>"))
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")
    span = tag("timeInterval", F.concat(tag("start", when(F.col("day").cast("timestamp"))), tag("end", when(F.date_add("day", 1).cast("timestamp")))))

    def series(sequence: int, mrid, curve, resolution):
        fields = F.concat(tag("mRID", mrid), tag("curveType", curve), tag("classificationSequence_AttributeInstanceComponent.position", F.lit(sequence)))
        return tag("TimeSeries", F.concat(fields, tag("Period", F.concat(span, tag("resolution", resolution), F.lit("<Point><position>1</position><price.amount>1.5</price.amount></Point>")))))

    quarter = F.lit("PT15M")
    second = series(2, F.when(n % 2 == 0, "a").otherwise("b"), F.when(n % 3 == 0, "A01").otherwise("A03"), F.when(n % 7 == 0, "PT60M").otherwise(quarter))
    body = F.concat(series(1, F.lit("a"), F.lit("A03"), quarter), second, F.when(n % 5 == 0, second).otherwise(""))
    return days.select("day", F.concat(F.lit("<Doc>"), body, F.lit("</Doc>")).alias("xml"))


register("aud_sequence_diff", "day:d path:s text:s n_a:i n_b:i",
         lambda s, d: docs.sequence_diff(saved(docs.paths(_sequence_documents(s, d), ["day"], day=(ts("2024-01-01"), ts("2024-02-01")))), ["day"]),
         """dy AS (SELECT DISTINCT ts::DATE AS d, day(ts::DATE) AS n FROM events), ok AS (SELECT * FROM dy WHERE n % 7 <> 0),
df AS (SELECT d, 'mRID' AS path, unnest(['a', 'b']) AS text, unnest([1, 0]) AS n_a, unnest([0, 1]) AS n_b FROM ok WHERE n % 2 = 1 AND n % 5 <> 0
  UNION ALL SELECT d, 'curveType', unnest(['A03', 'A01']), unnest([1, 0]), unnest([0, 1]) FROM ok WHERE n % 3 = 0 AND n % 5 <> 0
  UNION ALL SELECT d, NULL, NULL, 1, 2 FROM ok WHERE n % 5 = 0) ;; SELECT d AS day, path, text, n_a, n_b FROM df""")


def _odd_documents(s: SparkSession, d: str) -> DataFrame:
    """A document a day with fields that no code knows: of the document itself, and nested and repeated ones of its two
    series. By the day the second series has its notes in another order, a field more, or another unit."""
    days = ad.events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"))
    n = F.dayofmonth("day")
    tag = lambda t, v: F.concat(F.lit(f"<{t}>"), v.cast("string"), F.lit(f"</{t}>"))
    sequence = lambda k: tag("classificationSequence_AttributeInstanceComponent.position", F.lit(k))
    notes = lambda a, b: F.concat(tag("note", F.lit(a)), F.lit("<note> </note>"), tag("note", F.lit(b)))
    quality = lambda unit, x: tag("quality.x", F.concat(tag("unit", unit), x))
    first = tag("TimeSeries", F.concat(sequence(1), quality(F.lit("MW"), notes("a &amp; b", "c")), F.lit("<Period><resolution>PT15M</resolution></Period>")))
    swapped = F.when(n % 2 == 0, notes("c", "a &amp; b")).otherwise(notes("a &amp; b", "c"))
    more = F.when(n % 3 == 0, F.lit('<extra kind="k"><deep><deeper>7</deeper></deep></extra>')).otherwise("")
    second = tag("TimeSeries", F.concat(sequence(2), quality(F.when(n % 5 == 0, "kW").otherwise("MW"), swapped), more))
    head = F.concat(F.lit("<revision>007</revision>"), tag("sender", tag("events", F.col("n_events"))))
    return days.select("day", F.concat(F.lit('<Doc xmlns="urn:x">'), head, first, second, F.lit("</Doc>")).alias("xml"))


_DOC_DAYS = "dy AS (SELECT ts::DATE AS d, day(ts::DATE) AS n, count(*) AS n_events FROM events GROUP BY 1, 2)"
_QUALITY = "'quality.x.unit', CASE WHEN n % 5 = 0 THEN 'kW' ELSE 'MW' END"
register(
    "src_document_fields", "day:d ts_index:i path:s text:s", lambda s, d: docs.flatten_fields(_odd_documents(s, d), ["day"]),
    f"""{_DOC_DAYS},
f AS (
  SELECT d, NULL AS ts_index, unnest(['revision', 'sender.events']) AS path, unnest(['007', n_events::VARCHAR]) AS text FROM dy
  UNION ALL SELECT d, 0, unnest(['classificationSequence_AttributeInstanceComponent.position', 'quality.x.unit', 'quality.x.note', 'quality.x.note']), unnest(['1', 'MW', 'a & b', 'c']) FROM dy
  UNION ALL SELECT d, 1, unnest(['classificationSequence_AttributeInstanceComponent.position', {_QUALITY.split(',')[0]}, 'quality.x.note', 'quality.x.note']),
    unnest(['2', {_QUALITY.split(',', 1)[1]}, 'a & b', 'c']) FROM dy
  UNION ALL SELECT d, 1, 'extra.deep.deeper', '7' FROM dy WHERE n % 3 = 0) ;;
SELECT d AS day, ts_index, path, text FROM f""",
)


def _field_diff(s: SparkSession, d: str) -> DataFrame:
    found = docs.field_diff(docs.paths(_odd_documents(s, d), ["day"]), ["day"])
    return found.withColumns({c: F.array_join(c, "|") for c in ("texts_a", "texts_b")})


register(
    "aud_field_diff", "day:d path:s texts_a:s texts_b:s", _field_diff,
    f"""{_DOC_DAYS} ;;
SELECT d AS day, 'quality.x.note' AS path, 'a & b|c' AS texts_a, 'c|a & b' AS texts_b FROM dy WHERE n % 2 = 0
UNION ALL SELECT d, 'quality.x.unit', 'MW', 'kW' FROM dy WHERE n % 5 = 0
UNION ALL SELECT d, 'extra.deep.deeper', '', '7' FROM dy WHERE n % 3 = 0""",
)


def _sequenced(s: SparkSession, d: str) -> DataFrame:
    return ad.events(s, d).select("event_id", F.date_trunc("hour", "ts").alias("timestamp_utc"), "value", F.nullif(F.col("event_id") % 3, F.lit(0)).alias("sequence"))


_SEQ = "sq AS (SELECT event_id, date_trunc('hour', ts) AS t, value, nullif(event_id % 3, 0) AS sequence FROM events), k AS (SELECT * FROM sq WHERE sequence IS NULL OR sequence = 1)"
_DUP = "SELECT '{0}' AS stage, t >= TIMESTAMP '2024-01-14 23:00:00' AS post, count(*) AS n_keys, sum(n) AS n_rows FROM (SELECT t, count(*) AS n FROM {1} GROUP BY 1 HAVING n > 1) GROUP BY 2"
register("aud_selection_effect", "stage:s post:b n_keys:i n_rows:i", lambda s, d: docs.selection_effect(_sequenced(s, d), ts("2024-01-14 23:00:00")), f"{_SEQ} "
    f";; {_DUP.format('before', 'sq')} UNION ALL {_DUP.format('after', 'k')}")
register("sel_sequence", "event_id:i value:f", lambda s, d: docs.select_sequence(_sequenced(s, d)), f"{_SEQ} ;; SELECT event_id, value FROM k")

# --- outputs, written into the shared folder and read back ------------------------------------------


def _round_trip(write, read):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = tables.scratch(s)
        write(ad.a1(s, d), path)
        return read(s, path)

    return run


_A1 = f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, price FROM a1"
_CSV = "series_id string, timestamp_utc timestamp, price double"
register("snk_parquet_overwrite", f"{KEY} price:f", _round_trip(lambda r, p: tables.write_overwrite(r, p, ("series_id",)), lambda s, p: s.read.parquet(p)), _A1)
register("snk_versioned_immutable", f"{KEY} price:f", _round_trip(tables.write_version, lambda s, p: s.read.parquet(p)), _A1)
register("snk_csv_table", f"{KEY} price:f", _round_trip(lambda r, p: tables.write_csv_table(r, p, ROWS), lambda s, p: s.read.schema(_CSV).option("header", True).csv(p)), _A1)
register("src_csv_series", "timestamp_utc:t price:f fold:s",
         _round_trip(lambda r, p: [r.where(F.col("series_id") == n).drop("series_id").write.option("header", True).csv(f"{p}/{n}.csv") for n in ("view", "click")],
                     lambda s, p: tables.read_csv_series(s, [f"{p}/view.csv", f"{p}/click.csv"], "timestamp_utc timestamp, price double", ["timestamp_utc", "price"])),
         f"{ad.A1} ;; SELECT t AS timestamp_utc, price, series_id AS fold FROM a1 WHERE series_id IN ('view', 'click')")
register("snk_ingestion_log", "series_id:s raw_row_count:i", _round_trip(lambda r, p: tables.write_ingestion_log(r, "series_id", p), lambda s, p: s.read.json(p)), f"{ad.A1} "
    f";; SELECT series_id, count(*) AS raw_row_count FROM a1 GROUP BY 1")
register("src_jsonl_log", "chunk:s n:i", _round_trip(lambda r, p: r.select(F.col("series_id").alias("data_type"), F.date_format("timestamp_utc", "yyyy-MM-dd").alias("chunk")).write.json(p),
                                                     lambda s, p: tables.read_jsonl_log(s, p, "data_type string, "
                                                     "chunk string", "view").groupBy("chunk").agg(F.count("*").alias("n"))),
         f"{ad.A1} ;; SELECT strftime(t, '%Y-%m-%d') AS chunk, count(*) AS n FROM a1 WHERE series_id = 'view' GROUP BY 1")
register("snk_manifest", "source:s n_rows:i first:t last:t", _round_trip(lambda r, p: tables.write_manifest(r, {"source": "events"}, p), lambda s, p: s.read.schema("source string, "
    "n_rows long, first timestamp, last timestamp").json(p)),
         f"{ad.A1} ;; SELECT 'events' AS source, count(*) AS n_rows, min(t) AS first, max(t) AS last FROM a1")

def _bucketed(s: SparkSession, d: str) -> DataFrame:
    """The hourly prices in folders of ten days, of which the second is written again with other prices."""
    rows = ad.a1(s, d).withColumn("decade", F.floor((F.dayofmonth("timestamp_utc") - 1) / 10).cast("int"))
    name = "series_" + tables.scratch(s).rpartition("-")[2]
    tables.write_series(rows, name, part="decade", buckets=8)
    tables.replace_parts(rows.where("decade = 1").withColumn("price", F.col("price") + 1000), name)
    return s.table(name)


register(
    "snk_bucketed_series", f"{KEY} price:f", _bucketed,
    f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, CASE WHEN day(t) BETWEEN 11 AND 20 THEN price + 1000 ELSE price END AS price FROM a1",
)

# --- streams over the files of a table, until what is there is read -----------------------------------


def _streamed(change):
    def run(s: SparkSession, d: str) -> DataFrame:
        # a pattern, since a table may be one file, which a stream's path must not be
        path, schema = tables.scratch(s), tables.read_table(s, d, "events").schema
        rows = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"), "event_id", "value")
        query = change(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return s.read.parquet(f"{path}/out")

    return run


# an hour is given out when the watermark, two hours before the last event, has passed its end
register("str_resample_hourly", f"{KEY} value:f n:i", _streamed(lambda r: streaming.resample_hourly_stream(r, "value")),
         "SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp_utc, avg(value) AS value, count(*) AS n FROM events, (SELECT max(ts) AS last FROM events) "
         "GROUP BY 1, 2, last HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= last - INTERVAL 2 HOUR")
register("str_dedupe", KEY, _streamed(lambda r: streaming.dedupe_stream(r.withColumn("timestamp_utc", F.date_trunc("second", "timestamp_utc")), ROWS)),
         "SELECT DISTINCT event_type AS series_id, date_trunc('second', ts) AS timestamp_utc FROM events")

# --- column functions -------------------------------------------------------------------------------
register("fn_bool_coerce", "event_id:i flag:b", lambda s, d: ad.events(s, d).withColumn("flag", fn.bool_coerce(F.get(F.array(*[F.lit(x) for x in (" TRUE", "0", "x", None, "1 ", "False")]), (F.col("event_id") % 6).cast("int")))),
         "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS flag FROM events")
register("fn_numeric_coerce", "event_id:i number:f", lambda s, d: ad.events(s, d).withColumn("number", fn.numeric_coerce(F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "NaN").when(F.col("event_id") % 4 == 2, "abc").otherwise("-Infinity"))),
         "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value END AS number FROM events")
register("fn_classify_match", "timestamp_utc:t match:s", lambda s, d: ad.a6(s, d).withColumn("match", fn.classify_match(F.col("price_ref"), F.col("price_seq1"), F.col("price_seq2"), 0.01)),
         f"{ad.A6} ;; SELECT t AS timestamp_utc, CASE WHEN price_ref IS NULL THEN 'no_data' WHEN a "
         f"AND b THEN 'both' WHEN a THEN 'seq1' WHEN b THEN 'seq2' ELSE 'neither' END AS match FROM (SELECT *, coalesce(abs(price_ref - price_seq1) <= 0.01, "
         f"false) AS a, coalesce(abs(price_ref - price_seq2) <= 0.01, false) AS b FROM a6)")
register("fn_string_date", f"{KEY} month:s label:s", lambda s, d: ad.a1(s, d).withColumns({"month": F.date_format(fn.local_time(F.col("timestamp_utc")), "yyyy-MM"), "label": F.concat("series_id", F.lit(" "), F.date_format(fn.local_time(F.col("timestamp_utc")), "HH:mm"))}),
         f"{ad.A1} ;; SELECT series_id, t AS timestamp_utc, strftime({B('t')}, '%Y-%m') AS month, series_id || ' ' || strftime({B('t')}, '%H:%M') AS label FROM a1")
_CELLS = [(e, c) for e in (0.80, 0.85, 0.90) for c in (5.0, 10.0, 15.0)]
_CELL_SQL = "cells AS (SELECT e::DOUBLE AS eta, c::DOUBLE AS c FROM (VALUES " + ", ".join(map(str, _CELLS)) + ") v(e, c)), dd AS (SELECT DISTINCT series_id, " + B("t") + "::DATE AS d FROM a1)"


def _grid(s: SparkSession, d: str) -> DataFrame:
    days = forecast.day_of(ad.a1(s, d)).select("series_id", "delivery_date").distinct()
    return joins.with_cells(days, _CELLS).withColumn("cost", fn.degradation_cost(F.col("c"), F.col("eta")))


register("win_in_buckets", f"{KEY} lagged:f r_mean:f r_std:f",
         lambda s, d: timeseries.in_buckets(timeseries.regularize(ad.a1(s, d)), 7, 48, lambda r: timeseries.rolling_stats(timeseries.safe_lag(r, "price", 24, "lagged"), "lagged", 24, "r")),
         f"{ad.REG}, lg AS (SELECT r.series_id, r.t, p.price AS lagged FROM reg r LEFT JOIN reg p ON p.series_id = r.series_id AND p.t + INTERVAL 24 HOUR = r.t) "
         f";; SELECT series_id, t AS timestamp_utc, lagged, CASE WHEN count(lagged) OVER w >= 19 THEN avg(lagged) OVER w END AS r_mean, CASE WHEN count(lagged) "
         f"OVER w >= 19 THEN stddev_samp(lagged) OVER w END AS r_std FROM lg WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN INTERVAL 23 HOUR PRECEDING "
         f"AND CURRENT ROW)")
register("jn_cross_grid", f"{_DAYS} eta:f c:f", _grid, f"{ad.A1}, {_CELL_SQL} ;; SELECT series_id, d AS delivery_date, eta, c FROM dd, cells")
register("fn_degradation_cost", f"{_DAYS} eta:f c:f cost:f", _grid, f"{ad.A1}, {_CELL_SQL} ;; SELECT series_id, d AS delivery_date, eta, c, c * (1 + eta) AS cost FROM dd, cells")

# --- joins, sets, order -----------------------------------------------------------------------------
register("jn_self_lag", f"{KEY} lagged:f", lambda s, d: joins.lag_join(timeseries.regularize(ad.a1(s, d)), "price", 6, "lagged"),
         f"{ad.REG} ;; SELECT r.series_id, r.t AS timestamp_utc, p.price AS lagged FROM reg r LEFT JOIN reg p ON p.series_id = r.series_id AND p.t + INTERVAL 6 HOUR = r.t")
_two = lambda s, d: [ad.a1(s, d).where(F.col("series_id") == n).select("timestamp_utc", "price") for n in ("purchase", "view")]
_TWO = f"{ad.A1}, p AS (SELECT t, price AS purchase FROM a1 WHERE series_id = 'purchase'), v AS (SELECT t, price AS view FROM a1 WHERE series_id = 'view')"
register("jn_inner_two_models", "timestamp_utc:t purchase:f view:f", lambda s, d: joins.two_models(*_two(s, d), ("purchase", "view"), "price"), f"{_TWO} "
    f";; SELECT t AS timestamp_utc, purchase, view FROM p JOIN v USING (t)")
register("jn_outer_indicator", "timestamp_utc:t side:s", lambda s, d: joins.one_sided(*_two(s, d), ["timestamp_utc"]),
         f"{_TWO} ;; SELECT t AS timestamp_utc, CASE WHEN purchase IS NULL THEN 'right' ELSE 'left' END AS side FROM p FULL JOIN v USING (t) "
         f"WHERE purchase IS NULL OR view IS NULL")
register("set_grid_difference", "timestamp_utc:t side:s", lambda s, d: checks.set_difference(*[x.select("timestamp_utc") for x in _two(s, d)]),
         f"{_TWO} ;; SELECT t AS timestamp_utc, 'left' AS side FROM (SELECT t FROM p EXCEPT SELECT t FROM v) UNION ALL SELECT t, 'right' FROM (SELECT t "
         f"FROM v EXCEPT SELECT t FROM p)")
register("set_day_equality", "n_different:i", lambda s, d: checks.set_difference(*[x.select(fn.local_date(F.col("timestamp_utc")).alias("day")).distinct() for x in _two(s, d)]).agg(F.count("*").alias("n_different")),
         f"{_TWO} ;; SELECT count(*) FILTER (p.d IS NULL OR v.d IS NULL) AS n_different FROM (SELECT DISTINCT {B('t')}::DATE AS d FROM p) p FULL "
         f"JOIN (SELECT DISTINCT {B('t')}::DATE AS d FROM v) v ON p.d = v.d")
register("jn_semi_days", f"{KEY} price:f", lambda s, d: ad.a5(s, d).join(decisions.common_days(ad.a5(s, d), ad.REQUIRED), ["series_id", "delivery_date"], "left_semi"), f"{ad.a7_sql()} "
    f";; SELECT series_id, t AS timestamp_utc, price FROM placed")


register("jn_range_window", f"{_DAYS} n:i total:f", lambda s, d: joins.trailing_days(ad.a1(s, d), "price", 7),
         f"{ad.A1}, x AS (SELECT series_id, price, {B('t')}::DATE AS d, unnest(generate_series(1, 7)) AS k FROM a1) ;; SELECT series_id, "
         f"(d + k::INT)::DATE AS delivery_date, count(*) AS n, sum(price) AS total FROM x GROUP BY 1, 2")
register("win_first_appearance_order", "series_id:s first_seen:t n:i", lambda s, d: joins.by_first_appearance(ad.a1(s, d)),
         f"{ad.A1} ;; SELECT series_id, min(t) AS first_seen, count(*) AS n FROM a1 GROUP BY 1")
register("srt_select_min_score", "series_id:s hour_local:i score:f",
         lambda s, d: joins.lowest(timeseries.add_local_columns(ad.a1(s, d)).groupBy("series_id", "hour_local").agg(F.round(F.avg("price"), 6).alias("v")), ["series_id"], "hour_local", F.col("v")),
         f"{ad.A1}, h AS (SELECT series_id, hour({B('t')}) AS h, round(avg(price), 6) AS score FROM a1 GROUP BY 1, 2), r AS (SELECT *, row_number() "
         f"OVER (PARTITION BY series_id ORDER BY score, h) AS rn FROM h) ;; SELECT series_id, h AS hour_local, score FROM r WHERE rn = 1")
def _audit_dates(s: SparkSession, d: str) -> DataFrame:
    rows = forecast.day_of(ad.a6(s, d)).withColumns({"series_id": F.lit("events"), "abs_diff": F.abs(F.col("price_seq1") - F.col("price_seq2"))})
    return checks.disagreement_dates(rows.where("abs_diff > 0.01"), timeseries.dst_days(rows), 6)


_PLACES = "[round_even(i * (n - 1) / (sl - 1), 0)::BIGINT FOR i IN range(sl)]"
register("smp_audit_dates", f"{_DAYS} reason:s", _audit_dates,
         f"""{ad.A6}, dd AS (SELECT {B('t')}::DATE AS d, max(abs(price_seq1 - price_seq2)) AS gap FROM a6 WHERE abs(price_seq1 - price_seq2) > 0.01 GROUP BY 1),
ds AS (SELECT {B('t')}::DATE AS d FROM a6 GROUP BY 1 HAVING count(DISTINCT epoch({B('t')}) - epoch(t)) > 1),
r AS (SELECT *, count(*) OVER () AS n, least(6, count(*) OVER ()) AS sl, row_number() OVER (ORDER BY d) AS up, row_number() OVER (ORDER BY gap DESC, d) AS large, row_number() OVER (ORDER BY gap, d) AS small FROM dd),
p AS (SELECT *, CASE WHEN d IN (SELECT d FROM ds) THEN 0 WHEN up = 1 THEN 1 WHEN up = n THEN 2 WHEN large = 1 THEN 3 WHEN small = 1 THEN 4 WHEN list_contains({_PLACES}, up - 1) THEN 5 ELSE 6 END AS pr FROM r),
q AS (SELECT *, row_number() OVER (ORDER BY pr, CASE WHEN pr = 6 THEN large ELSE up END) AS rn FROM p)
;; SELECT 'events' AS series_id, d AS delivery_date, ['dst', 'first', 'last', 'largest', 'smallest', 'spaced', 'rest'][pr + 1] AS reason FROM q WHERE rn <= 6""")

# --- folds and forecasts ----------------------------------------------------------------------------
_W = "w AS (SELECT strftime(wk, '%Y-%m-%d') AS name, wk::TIMESTAMP AS wk, min(t) AS first FROM (SELECT date_trunc('week', t) AS wk, t FROM a1) GROUP BY 1, 2)"


def _weeks(s: SparkSession, d: str) -> DataFrame:
    """A fold a week, validated on eight days, so that neighbours overlap."""
    wk = F.date_trunc("week", "timestamp_utc")
    return ad.a1(s, d).groupBy(wk.alias("wk")).agg(F.min("timestamp_utc").alias("train_start")).select(
        F.date_format("wk", "yyyy-MM-dd").alias("name"), "train_start", (F.col("wk") + F.expr("interval 2 days")).alias("train_end"), (F.col("wk") + F.expr("interval 1 days")).alias("val_start"), (F.col("wk") + F.expr("interval 9 days")).alias("val_end"))


register("spl_validate", "name:s other:s rule:s", lambda s, d: splits.violations(_weeks(s, d)),
         f"{ad.A1}, {_W} ;; SELECT name, NULL AS other, 'order' AS rule FROM w UNION ALL SELECT a.name, b.name, 'overlap' FROM w a JOIN w b ON a.name < b.name "
         f"AND b.wk < a.wk + INTERVAL 8 DAY")
register("spl_final_and_holdout", "role:s series_id:s n:i price:f", lambda s, d: splits.final_and_holdout(ad.a1(s, d), ts("2024-01-22")).groupBy("role", "series_id").agg(F.count("*").alias("n"), F.sum("price").alias("price")),
         f"{ad.A1} ;; SELECT CASE WHEN t < TIMESTAMP '2024-01-22' THEN 'final_train' ELSE 'holdout' END AS role, series_id, count(*) AS n, sum(price) AS price FROM a1 "
         f"GROUP BY 1, 2")
register("spl_row_cv", "series_id:s fold:i train_rows:i test_rows:i test_start:t test_end:t", lambda s, d: splits.row_cv(ad.a1(s, d), 3),
         f"{ad.A1}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM a1), f "
         f"AS (SELECT *, n // 4 AS test, n - (3 - fold) * (n // 4) AS st FROM r, (SELECT unnest([0, 1, 2]) AS fold)) ;; SELECT series_id, fold, "
         f"count(*) FILTER (r < st) AS train_rows, count(*) FILTER (r >= st AND r < st + test) AS test_rows, min(t) FILTER (r >= st AND r < st + test) AS test_start, "
         f"max(t) FILTER (r >= st AND r < st + test) AS test_end FROM f GROUP BY 1, 2")
def _stacked(s: SparkSession, d: str) -> DataFrame:
    rows = saved(ad.a5(s, d))
    return splits.stack_folds({str(n): rows.where(F.col("fold") == n) for n in (2, 3)})


register("set_union_folds", "fold:i n:i n_keys:i", lambda s, d: _stacked(s, d).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("series_id", "timestamp_utc").alias("n_keys")),
         f"{ad.A5} ;; SELECT fold, count(*) AS n, count(DISTINCT (series_id, t)) AS n_keys FROM a5 WHERE fold IN (2, 3) GROUP BY 1")


def _naive(s: SparkSession, d: str) -> DataFrame:
    rows = timeseries.safe_lag(timeseries.safe_lag(timeseries.regularize(ad.a1(s, d)), "price", 24, "lag_24"), "price", 168, "lag_168")
    return forecast.weekday_naive(rows, "lag_24", "lag_168")


_NAIVE = f"{ad.REG}, nv AS (SELECT r.series_id, r.t, CASE WHEN {B('(r.t - INTERVAL 24 HOUR)')}::DATE < {B('r.t')}::DATE THEN p.price END AS lag_24, q.price AS lag_168, isodow({B('r.t')}) AS dow FROM reg r LEFT JOIN reg p ON p.series_id = r.series_id AND p.t + INTERVAL 24 HOUR = r.t LEFT JOIN reg q ON q.series_id = r.series_id AND q.t + INTERVAL 168 HOUR = r.t)"
register("ml_naive", f"{KEY} lag_24:f lag_168:f", _naive, f"{_NAIVE} ;; SELECT series_id, t AS timestamp_utc, lag_24, lag_168 FROM nv")
register("ml_weekday_naive", f"{KEY} weekday_pred:f", _naive, f"{_NAIVE} ;; SELECT series_id, t AS timestamp_utc, CASE WHEN dow BETWEEN 2 "
    f"AND 5 THEN lag_24 ELSE lag_168 END AS weekday_pred FROM nv")
def _evaluated(s: SparkSession, d: str) -> DataFrame:
    """The lag and a linear model fitted on the folds before, on the same rows."""
    rows, features = ad.a5(s, d).select(*ROWS, "price", "pred_full", "pred_alt", "fold"), ["pred_full", "pred_alt"]
    fits = {"lag": lambda train: forecast.Naive("pred_full"), "linear": lambda train: forecast.elastic_net(train, features, "price", 0.0, 0.5)}
    made = forecast.evaluate_folds(rows, features, "price", fits, [2, 3, 4], ROWS)
    return metrics.point_metrics(made, ["model", "fold"])


register("ml_evaluate_fold", "model:s fold:i n:i mae:f rmse:f median_ae:f", _evaluated,
         f"{ad.A5}, cr AS (SELECT coalesce(fold, 0) AS f, price AS y, pred_full AS a, pred_alt AS b FROM a5 WHERE price IS NOT NULL AND pred_full IS NOT NULL "
         f"AND pred_alt IS NOT NULL), "
         "mo AS (SELECT i, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, "
         "y) AS bb FROM cr JOIN (SELECT unnest([2, 3, 4]) AS i) ON f < i GROUP BY i), "
         "so AS (SELECT *, (ay * vb - bb * ab) / (va * vb - ab * ab) AS wa, (bb * va - ay * ab) / (va * vb - ab * ab) AS wb FROM mo), "
         f"k AS (SELECT 'lag' AS model, f AS fold, y AS price, a AS p FROM cr WHERE f >= 2 UNION ALL SELECT 'linear', f, y, my + wa * (a - ma) + wb * (b - mb) FROM cr "
         f"JOIN so ON so.i = cr.f) ;; SELECT model, fold, {_METRIC} FROM k GROUP BY 1, 2")

# --- uncertainty ------------------------------------------------------------------------------------
register("unc_interval_score", f"{KEY} score:f", lambda s, d: ad.a5(s, d).where("L is not null and price is not null").withColumn("score", fn.winkler(F.col("price"), F.col("L"), F.col("U"), 0.2)),
         f"{ad.A5} ;; SELECT series_id, t AS timestamp_utc, (u - l) + (greatest(l - price, 0) + greatest(price - u, 0)) * 10 AS score FROM a5 WHERE l IS NOT NULL "
         f"AND price IS NOT NULL")
register("unc_day_safe_offset", f"{_DAYS} q10:f q50:f q90:f", lambda s, d: uncertainty.day_safe_quantiles(ad.a5(s, d), "residual", 7, 1), f"{ad.A5} "
    f";; SELECT series_id, d AS delivery_date, q10, q50, q90 FROM q")
register("unc_sequential_update", f"{_DAYS} q10:f q50:f q90:f", lambda s, d: uncertainty.day_safe_quantiles(ad.a5(s, d).where("fold is not null"), "residual", 7, 1),
         f"{ad.A5}, f AS (SELECT series_id, d, residual AS r, unnest(generate_series(1, 7)) AS k FROM rolled WHERE isfinite(residual) AND fold IS NOT NULL) "
         f";; SELECT series_id, (d + k::INT)::DATE AS delivery_date, quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.9) AS q90 FROM f "
         f"GROUP BY 1, 2")


def _sequential_stream(s: SparkSession, d: str) -> DataFrame:
    """The residuals of ``a5`` as files of six days each, read some at a time by a stream that keeps seven days."""
    path = tables.scratch(s)
    rows = saved(ad.a5(s, d).where("fold is not null").select(*ROWS, "residual"))
    for k in range(5):
        part = rows.where(F.floor(F.datediff("timestamp_utc", F.lit("2024-01-01")) / 6) == k)
        part.write.mode("append").parquet(f"{path}/in")
    store = sequential.STORE[0]
    old = s.conf.get(store, None)
    sequential.use_rocksdb(s)
    try:
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
        made = sequential.sequential_quantiles(stream, "residual", 7, 1, late="7 days")
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.unset(store) if old is None else s.conf.set(store, old)
    return s.read.parquet(f"{path}/out")


register(
    "unc_sequential_stream", f"{_DAYS} q10:f q50:f q90:f n_days:i", _sequential_stream,
    f"""{ad.A5},
sr AS (SELECT series_id, t, d, residual AS r FROM rolled WHERE isfinite(residual) AND fold IS NOT NULL),
f AS (SELECT series_id, d, r, unnest(generate_series(1, 7)) AS k FROM sr),
la AS (SELECT max(t) - INTERVAL 7 DAY AS mark FROM sr) ;;
SELECT series_id, (d + k::INT)::DATE AS delivery_date, quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.9) AS q90, count(DISTINCT d) AS n_days
FROM f, la GROUP BY 1, 2, mark HAVING (d + k::INT)::DATE::TIMESTAMP - INTERVAL 1 HOUR <= mark""",
)
register("fn_price_bounds", f"{KEY} L:f U:f", lambda s, d: uncertainty.attach_bounds(ad.a5(s, d).select(*ROWS, "pred_alt"), "pred_alt", uncertainty.day_safe_quantiles(ad.a5(s, d), "residual", 7, 1)),
         f"{ad.A5} ;; SELECT series_id, t AS timestamp_utc, pred_alt + q10 AS L, pred_alt + q90 AS U FROM a5")
_TIERS = f"{ad.A5}, {ad.QA}, tt AS (SELECT a5.*, a10, a90 FROM a5 LEFT JOIN qa ON qa.series_id = a5.series_id AND qa.d = a5.d)"


def _tiers(s: SparkSession, d: str) -> DataFrame:
    """Predictions with the offsets of each model's residuals, attached by day."""
    rows = saved(ad.a5(s, d))
    out = forecast.day_of(rows.select(*ROWS, "price", "pred_full", "pred_alt"))
    for n, p in (("f", "pred_full"), ("a", "pred_alt")):
        off = uncertainty.day_safe_quantiles(rows.withColumn("r", F.col("price") - F.col(p)), "r", 7, 1, (0.1, 0.9))
        out = out.join(off.withColumnsRenamed({"q10": f"{n}10", "q90": f"{n}90"}), ["series_id", "delivery_date"], "left")
    return out


def _crossed(s: SparkSession, d: str, pairs: list[tuple[str, str]]) -> DataFrame:
    cell = lambda p, e: F.struct(F.lit(p).alias("point"), F.lit(e).alias("envelope"), (F.col(f"pred_{p}") + F.col(f"{e[0]}10")).alias("L"), (F.col(f"pred_{p}") + F.col(f"{e[0]}90")).alias("U"))
    long = _tiers(s, d).select("price", F.explode(F.array(*[cell(*x) for x in pairs])).alias("x")).select("price", "x.*")
    return uncertainty.calibration(long, ["point", "envelope"])


_CROSS = lambda pairs: "x AS (" + " UNION ALL ".join(f"SELECT '{p}' AS point, '{e}' AS envelope, price, pred_{p} + {'q' if e == 'full' else 'a'}10 AS l, "
    f"pred_{p} + {'q' if e == 'full' else 'a'}90 AS u FROM tt" for p, e in pairs) + ")"  # noqa: E731
_SAME, _ALL = [("full", "full"), ("alt", "alt")], [(p, e) for p in ("full", "alt") for e in ("full", "alt")]
for _name, _pairs in (("unc_tier_compare", _SAME), ("unc_point_envelope_cross", _ALL)):
    register(_name, f"point:s envelope:s n:i {_CAL}", lambda s, d, p=_pairs: _crossed(s, d, p), f"{_TIERS}, {_CROSS(_pairs)} ;; SELECT point, envelope, {_CALSQL} "
        f"FROM x WHERE l IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2")
register("jn_left_attach_bounds", f"{KEY} f10:f f90:f a10:f a90:f", _tiers, f"{_TIERS} ;; SELECT series_id, t AS timestamp_utc, q10 AS f10, q90 AS f90, a10, a90 FROM tt")

# --- decisions, reports, checks ---------------------------------------------------------------------


def _pairs_of(s: SparkSession, d: str, naive: bool) -> DataFrame:
    rows = decisions.positions(ad.complete(s, d)).select("series_id", "delivery_date", "pos", F.col("pred_full").alias("bid"), F.col("pred_full").alias("ask"), F.lit(0.85).alias("eta"), F.lit(18.5).alias("cost"))
    rows = saved(rows) if naive else rows
    return (decisions.best_pair_naive if naive else decisions.best_pair)(rows, ["series_id", "delivery_date"])


_BEST = f"{ad.a7_sql()} ;; SELECT series_id, d AS delivery_date, CASE WHEN score > 0 THEN i END AS i, CASE WHEN score > 0 THEN j END AS j, CASE WHEN score > 0 THEN score END AS score FROM best WHERE strategy = 'S1'"
for _name, _naive_way in (("st_best_pair", False), ("st_best_pair_naive", True)):
    register(_name, f"{_DAYS} i:i j:i score:f", lambda s, d, w=_naive_way: _pairs_of(s, d, w), _BEST)


def _all_pairs(s: SparkSession, d: str) -> DataFrame:
    """How many ordered pairs each day has, how many of them pay, and the mean of their scores."""
    rows = saved(decisions.positions(ad.complete(s, d)).select("series_id", "delivery_date", "pos", F.col("pred_full").alias("bid"), F.col("pred_full").alias("ask"), F.lit(0.85).alias("eta"), F.lit(18.5).alias("cost")))
    pairs = decisions.all_pairs(rows, ["series_id", "delivery_date"])
    return pairs.groupBy("series_id", "delivery_date").agg(F.count("*").alias("n_pairs"), F.sum((F.col("score") > 0).cast("long")).alias("n_paying"), F.avg("score").alias("mean_score"))


register("jn_self_pair_theta", f"{_DAYS} n_pairs:i n_paying:i mean_score:f", _all_pairs,
         f"{ad.a7_sql()} ;; SELECT series_id, d AS delivery_date, count(*) AS n_pairs, count(*) FILTER (score > 0) AS n_paying, avg(score) AS mean_score FROM pairs "
         f"WHERE strategy = 'S1' GROUP BY 1, 2")
register("st_realized", f"{_DAYS} gross_pnl:f net_pnl:f", lambda s, d: ad.a7(s, d).where("strategy = 'S2'"), f"{ad.a7_sql()} ;; SELECT series_id, d AS delivery_date, "
    f"gross_pnl, net_pnl FROM a7 WHERE strategy = 'S2'")
register("st_oracle", f"{_DAYS} oracle_pnl:f", lambda s, d: ad.a7(s, d).where("strategy = 'S0'"), f"{ad.a7_sql()} ;; SELECT series_id, d AS delivery_date, "
    f"net_pnl AS oracle_pnl FROM done WHERE strategy = 'oracle'")
def _swapped(days: DataFrame) -> DataFrame:
    """Results of which some days' pairs are turned over and some results lifted above the oracle's."""
    day, high = F.dayofmonth("delivery_date"), F.col("oracle_pnl") + 0.01
    turn = lambda a, b: F.when(day % 4 == 1, F.col(b)).otherwise(F.col(a)).alias(a)
    return days.select("series_id", "delivery_date", "strategy", turn("i", "j"), turn("j", "i"), F.when((F.col("strategy") == "S3") & (day % 6 == 2), high).otherwise(F.col("net_pnl")).alias("net_pnl"), "oracle_pnl")


register("st_invariants", f"{_DAYS} strategy:s", lambda s, d: decisions.invariant_violations(_swapped(ad.a7(s, d))),
         f"{ad.a7_sql()}, sw AS (SELECT series_id, d, strategy, CASE WHEN day(d) % 4 = 1 THEN j ELSE i END AS i, CASE WHEN day(d) % 4 = 1 THEN i ELSE j END AS j, "
         f"CASE WHEN strategy = 'S3' AND day(d) % 6 = 2 THEN oracle_pnl + 0.01 ELSE net_pnl END AS net_pnl, oracle_pnl FROM a7) ;; SELECT series_id, "
         f"d AS delivery_date, strategy FROM sw WHERE i >= j OR net_pnl > oracle_pnl + 1e-6")
register("st_invariants_clean", f"{_DAYS} strategy:s", lambda s, d: decisions.invariant_violations(ad.a7(s, d)), f"{ad.a7_sql()} ;; SELECT series_id, "
    f"d AS delivery_date, strategy FROM a7 WHERE i >= j OR net_pnl > oracle_pnl + 1e-6")
register("st_input_checks", f"{_DAYS} n_hours:i n_price:i n_L:i", lambda s, d: decisions.input_violations(ad.a5(s, d), ["price", "L"]),
         f"{ad.A5} ;; SELECT series_id, d AS delivery_date, count(*) AS n_hours, count(price) AS n_price, count(l) AS n_L FROM a5 GROUP BY 1, "
         f"2 HAVING n_hours NOT IN (23, 24, 25) OR n_price < n_hours OR n_L < n_hours")
register("risk_loss", f"{_DAYS} strategy:s loss:f", lambda s, d: reports.losses(ad.a7(s, d)), f"{ad.a7_sql()} ;; SELECT series_id, d AS delivery_date, strategy, "
    f"-net_pnl AS loss FROM a7")


def _changes(s: SparkSession, d: str) -> DataFrame:
    scores = saved(metrics.point_metrics(_scored(s, d), ["series_id", "model"]))
    old, new = (scores.where(F.col("model") == m).select("series_id", "mae", "rmse") for m in ("pred_full", "pred_alt"))
    return reports.table_diff(old, new, ["series_id"])


_DIFF = f"""{ad.A5}, {_LONG}, pm AS (SELECT series_id, model, {_METRIC} FROM k GROUP BY 1, 2), lg2 AS (SELECT series_id, model, 'mae' AS "column", mae AS v FROM pm UNION ALL SELECT series_id, model, 'rmse', rmse FROM pm),
df AS (SELECT o.series_id, o."column", o.v AS old, n.v AS new, n.v - o.v AS diff, (n.v - o.v) / o.v * 100 AS pct FROM lg2 o JOIN lg2 n ON o.series_id = n.series_id AND o."column" = n."column" WHERE o.model = 'pred_full' AND n.model = 'pred_alt')"""
register("rep_table_diff", "series_id:s column:s old:f new:f diff:f pct:f", lambda s, d: _changes(s, d), f"{_DIFF} ;; SELECT * FROM df")
register("top_changes", "series_id:s column:s pct:f", lambda s, d: reports.largest_changes(_changes(s, d), 3),
         f'{_DIFF}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY abs(pct) DESC, series_id) AS rn FROM df) ;; SELECT * FROM r WHERE rn <= 3')
_SHOWN = lambda c, kind: fn.display(F.col(c) + F.lit(1.2345e-9), kind).alias(c)
register("fn_display_format", "strategy:s net:s hit_rate:s traded_days:s", lambda s, d: reports.primary_table(ad.a7(s, d), ["strategy"]).select("strategy", _SHOWN("net", "eur"), _SHOWN("hit_rate", "percent"), fn.display(F.col("traded_days"), "count").alias("traded_days")),
         f"{ad.a7_sql()}, p AS (SELECT strategy, sum(net_pnl) + 1.2345e-9 AS net, avg((net_pnl > 0)::INT) FILTER (traded) + 1.2345e-9 AS hit, "
         f"count(*) FILTER (traded) AS n FROM a7 GROUP BY 1) ;; "
         "SELECT strategy, format('EUR {{:,.2f}}', net) AS net, coalesce(format('{{:.1f}}%', hit * 100), 'N/A') AS hit_rate, format('{{:,}}', n) AS traded_days FROM p".replace("{{", "{").replace("}}", "}"))
register("chk_pnl_rows", "rule:s violations:i", lambda s, d: checks.pnl_violations(saved(ad.broken(ad.a7(s, d))), "2024-01-25"),
         f"{ad.a7_sql()}, {ad.BROKEN} ;; SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS violations FROM br "
         f"WHERE {c}" for r, c in {"null_day": "d IS NULL", "holdout": "d >= DATE '2024-01-25'", "not_finite": "NOT isfinite(net_pnl)", "s0": "strategy = 'S0' "
         "AND net_pnl <> 0"}.items())
         + " UNION ALL SELECT 'duplicate_day', sum(n - 1) FROM (SELECT count(*) AS n FROM br GROUP BY series_id, d, strategy HAVING count(*) > 1)) WHERE violations > 0")
def _twice(s: SparkSession, d: str, change) -> tuple[DataFrame, DataFrame]:
    rows = saved(ad.a7(s, d))
    return rows, change(rows)


register("chk_reproduction", "field:s mismatches:i", lambda s, d: checks.reproduction(*_twice(s, d, lambda r: r.where("strategy <> 'S5'").withColumn("net_pnl", F.col("net_pnl") + F.when(F.col("strategy") == "S3", 0.01).otherwise(0.0))), ["series_id", "delivery_date", "strategy"], ["traded"], ["net_pnl", "gross_pnl"]),
         f"{ad.a7_sql()} ;; SELECT 'only_saved' AS field, count(*) FILTER (strategy = 'S5') AS mismatches FROM a7 UNION ALL SELECT 'only_computed', 0 "
         f"UNION ALL SELECT 'traded', 0 UNION ALL SELECT 'net_pnl', count(*) FILTER (strategy = 'S3') FROM a7 UNION ALL SELECT 'gross_pnl', 0")
def _table_diff(s: SparkSession, d: str) -> DataFrame:
    """``events`` against a copy that lacks some rows, has others besides, and differs in a column or two of some."""
    left = ad.events(s, d)
    n = F.col("event_id")
    kept = left.where(n % 1000 != 0).withColumns({"value": F.when(n % 777 == 0, F.col("value") + 1).otherwise(F.col("value")), "event_type": F.when(n % 1554 == 0, F.lit(None)).otherwise(F.col("event_type"))})
    right = kept.unionByName(left.where(n % 1500 == 1).withColumn("event_id", n + 1_000_000_000))
    return checks.table_diff(left, right, ["event_id"]).withColumn("columns", F.array_join("columns", ","))


register(
    "chk_table_diff", "event_id:i side:s columns:s", _table_diff,
    """SELECT event_id, 'left' AS side, NULL AS columns FROM events WHERE event_id % 1000 = 0
UNION ALL SELECT event_id + 1000000000, 'right', NULL FROM events WHERE event_id % 1500 = 1
UNION ALL SELECT event_id, 'changed', CASE WHEN event_id % 1554 = 0 THEN 'event_type,value' ELSE 'value' END FROM events WHERE event_id % 777 = 0 AND event_id % 1000 <> 0""",
)


def _holed(s: SparkSession, d: str) -> DataFrame:
    """Hours of which some are there twice and some lack their price."""
    rows = ad.a1(s, d)
    none = (F.hour("timestamp_utc") == 5) & (F.dayofmonth("timestamp_utc") % 3 == 0)
    return rows.withColumn("price", F.when(~none, F.col("price"))).unionByName(rows.where("hour(timestamp_utc) = 7"))


register("chk_exact_coverage", "series_id:s rule:s violations:i", lambda s, d: checks.coverage_violations(_holed(s, d), "2024-01-02", "2024-01-30"),
         f"""{ad.A1}, ho AS (SELECT series_id, t, CASE WHEN hour(t) = 5 AND day(t) % 3 = 0 THEN NULL ELSE price END AS price FROM a1 UNION ALL SELECT series_id, t, price FROM a1 WHERE hour(t) = 7),
ex AS (SELECT series_id, t, {B('t')}::DATE AS d FROM (SELECT DISTINCT series_id, unnest(generate_series(TIMESTAMP '2024-01-01 23:00:00', TIMESTAMP '2024-01-29 22:00:00', INTERVAL 1 HOUR)) AS t FROM a1)),
se AS (SELECT series_id, t, {B('t')}::DATE AS d, count(*) AS n, count(*) - count(price) AS bad FROM ho GROUP BY 1, 2, 3),
bo AS (SELECT coalesce(ex.series_id, se.series_id) AS series_id, coalesce(ex.d, se.d) AS d, ex.t IS NOT NULL AS w, se.t IS NOT NULL AS f, coalesce(n - 1, 0) AS twice, coalesce(bad, 0) AS bad FROM ex FULL JOIN se ON se.series_id = ex.series_id AND se.t = ex.t),
dy AS (SELECT series_id, d, sum(twice) AS duplicate_hours, count(*) FILTER (w AND NOT f) AS missing_hours, count(*) FILTER (f AND NOT w) AS extra_hours, sum(bad) AS bad_targets, (bool_or(w) AND NOT bool_or(f))::INT AS missing_days, (bool_or(f) AND NOT bool_or(w))::INT AS extra_days FROM bo GROUP BY 1, 2),
su AS (SELECT series_id, sum(duplicate_hours)::BIGINT AS duplicate_hours, sum(missing_hours)::BIGINT AS missing_hours, sum(extra_hours)::BIGINT AS extra_hours, sum(bad_targets)::BIGINT AS bad_targets, sum(missing_days)::BIGINT AS missing_days, sum(extra_days)::BIGINT AS extra_days FROM dy GROUP BY 1)
;; SELECT * FROM (UNPIVOT su ON duplicate_hours, missing_hours, extra_hours, bad_targets, missing_days, extra_days INTO NAME rule VALUE violations) WHERE violations > 0""")
register("chk_metric_reproduction", "series_id:s column:s pct:f", lambda s, d: _changes(s, d).where("abs(pct) > 0.1"), f"{_DIFF} ;; SELECT * FROM df WHERE abs(pct) > 0.1")
def _artifacts(s: SparkSession, d: str) -> DataFrame:
    """Hourly, per-day and grid tables of one run; the per-day table lacks a day, has another number of hours on one
    and another result of S2 on the 21st."""
    hours, day = saved(ad.complete(s, d)), F.dayofmonth("delivery_date")
    days = decisions.backtest(hours, ad.RULES, [(ad.ETA, ad.C)])
    grid = decisions.backtest(hours, ad.RULES, _CELLS).where((F.col("eta") == ad.ETA) & (F.col("c") == ad.C)).groupBy("series_id", "strategy").agg(F.sum("net_pnl").alias("net_pnl"))
    days = days.where(day != 23).withColumns({"n_hours": F.when(day == 22, 25).otherwise(F.col("n_hours")), "net_pnl": F.col("net_pnl") + F.when((day == 21) & (F.col("strategy") == "S2"), 0.5).otherwise(0.0)})
    return checks.artifact_differences(hours, days, grid)


register("chk_artifact_consistency", "series_id:s rule:s n:i", _artifacts,
         f"""{ad.a7_sql(_CELLS)}, b AS (SELECT * FROM a7 WHERE eta = 0.85 AND c = 10), h AS (SELECT DISTINCT series_id, d, n_hours FROM b),
tt AS (SELECT series_id, strategy, sum(net_pnl) FILTER (day(d) <> 23) + coalesce(0.5 * count(*) FILTER (day(d) = 21 AND strategy = 'S2'), 0) AS x, sum(net_pnl) AS y FROM b GROUP BY 1, 2)
;; SELECT series_id, 'days' AS rule, count(*) AS n FROM days WHERE day(d) = 23 OR NOT EXISTS (SELECT * FROM h WHERE h.series_id = days.series_id AND h.d = days.d) GROUP BY 1 UNION ALL SELECT series_id, 'n_hours', count(*) FROM h WHERE day(d) = 22 GROUP BY 1 UNION ALL SELECT series_id, 'totals', count(*) FROM tt WHERE abs(x - y) > 1e-6 GROUP BY 1""")
_PRICED, _LOADED = "purchase", "view"


def _raw(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two sources: prices by the hour before the cutover (one event an hour) and all after, and loads."""
    rows = ad.events(s, d).select(F.col("event_type").alias("kind"), F.col("ts").alias("timestamp_utc"), F.col("event_id").alias("order"), "value")
    price = rows.where(F.col("kind") == _PRICED).drop("kind")
    hourly = price.where(F.col("timestamp_utc") < ts("2024-01-14 23:00:00")).withColumn("timestamp_utc", F.date_trunc("hour", "timestamp_utc"))
    return {"price": hourly.unionByName(price.where(F.col("timestamp_utc") >= ts("2024-01-14 23:00:00"))), "load_mw": rows.where(F.col("kind") == _LOADED).drop("kind")}


def _build(s: SparkSession, d: str) -> DataFrame:
    return timeseries.build_clean(_raw(s, d), "price", ts("2024-01-14 23:00:00"), ts("2024-01-02"), ts("2024-01-29"), most=None)


_CUT = "TIMESTAMP '2024-01-14 23:00:00'"
_BUILD = f"""ra AS (SELECT 'price' AS k, CASE WHEN ts < {_CUT} THEN date_trunc('hour', ts) ELSE ts END AS t, event_id, value FROM events WHERE event_type = '{_PRICED}' UNION ALL SELECT 'load_mw', ts, event_id, value FROM events WHERE event_type = '{_LOADED}'),
dd AS (SELECT k, t, arg_min(value, event_id) AS v FROM ra GROUP BY 1, 2),
hh AS (SELECT k, date_trunc('hour', t) AS t, avg(v) AS v FROM dd GROUP BY 1, 2),
g AS (SELECT k, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM hh WHERE k = 'load_mw' OR t >= {_CUT} GROUP BY 1 UNION SELECT k, t FROM hh),
cl AS (SELECT g.t, max(v) FILTER (g.k = 'price') AS price, max(v) FILTER (g.k = 'load_mw') AS load_mw FROM g LEFT JOIN hh ON hh.k = g.k AND hh.t = g.t WHERE g.t >= TIMESTAMP '2024-01-02' AND g.t < TIMESTAMP '2024-01-29' GROUP BY 1)"""
register("cln_build", "timestamp_utc:t price:f load_mw:f post:i delivery_date:d hour_local:i weekend:i", _build,
         f"{_BUILD} ;; SELECT t AS timestamp_utc, price, load_mw, (t >= {_CUT})::INT AS post, {B('t')}::DATE AS delivery_date, hour({B('t')}) AS hour_local, "
         f"(isodow({B('t')}) >= 6)::INT AS weekend FROM cl")
register("cln_report", "dataset:s n_raw:i n_keys:i n_duplicates:i n_clean:i n_missing:i", lambda s, d: timeseries.cleaning_report(_raw(s, d), saved(_build(s, d))),
         f"{_BUILD}, rr AS (SELECT k AS dataset, count(*) AS n_raw, count(DISTINCT t) AS n_keys FROM ra GROUP BY 1), cc AS (SELECT 'price' AS dataset, "
         f"count(price) AS n_clean, count(*) - count(price) AS n_missing FROM cl UNION ALL SELECT 'load_mw', count(load_mw), count(*) - count(load_mw) FROM cl) "
         f";; SELECT *, n_raw - n_keys AS n_duplicates FROM rr JOIN cc USING (dataset)")


def _benchmark(s: SparkSession, d: str) -> DataFrame:
    return reports.benchmark_summary(metrics.point_metrics(_scored(s, d), ["model"]), ad.a7(s, d), {"pred_full": "S1", "pred_alt": "S2"})


register("rep_benchmark_summary", "model:s mae:f rmse:f net:f capture:f", _benchmark,
         f"{ad.a7_sql()}, {_LONG}, pm AS (SELECT model, {_METRIC} FROM k GROUP BY 1), pv "
         f"AS (SELECT CASE strategy WHEN 'S1' THEN 'pred_full' ELSE 'pred_alt' END AS model, sum(net_pnl) AS net, sum(net_pnl) / sum(oracle_pnl) AS capture FROM a7 "
         f"WHERE strategy IN ('S1', 'S2') GROUP BY 1) ;; SELECT model, mae, rmse, net, capture FROM pm JOIN pv USING (model)")


_WIDTHS = (3, 5, 7)


def _profile_windows(s: SparkSession, d: str) -> DataFrame:
    rows = saved(timeseries.add_local_columns(ad.a1(s, d)).select("series_id", "timestamp_utc", "delivery_date", "hour_local", "price"))
    hours, key = saved(ad.complete(s, d)).drop("n_hours").withColumn("hour_local", F.hour(fn.local_time(F.col("timestamp_utc")))), ["series_id", "delivery_date", "hour_local"]
    made = saved(forecast.trailing_profiles(rows, "price", list(_WIDTHS)))
    out = rows.join(made, key).groupBy("window_days").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("price") - F.col("profile_pred"))).alias("mae"))
    wide = made.groupBy(*key).pivot("window_days", list(_WIDTHS)).agg(F.first("profile_pred")).withColumnsRenamed({str(w): f"p{w}" for w in _WIDTHS})
    hours = hours.join(wide, key, "left")
    # P&L beside those of S2 (full) and S1 (lag 24), on days that all of them forecast whole
    hours = decisions.on_common_days(hours, [f"p{w}" for w in _WIDTHS])
    rules = {n: ad.RULES[n] for n in ("S1", "S2")} | {f"p{w}": (f"p{w}", f"p{w}") for w in _WIDTHS}
    gains = reports.profile_gains(decisions.backtest(hours, rules, [(ad.ETA, ad.C)]), {f"p{w}": w for w in _WIDTHS}, "S2", "S1")
    return out.join(gains, "window_days", "left")


_PROFILES = f"""{ad.a7_sql()}, r AS (SELECT series_id, {B('t')}::DATE AS day, hour({B('t')}) AS h, price AS v FROM a1), i AS (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k FROM (SELECT DISTINCT series_id, day FROM r)), rk AS (SELECT r.*, k FROM r JOIN i USING (series_id, day)),
pr AS (SELECT w, b.series_id, b.k, b.day, a.h, avg(a.v) AS p FROM (SELECT unnest([3, 5, 7]) AS w) ww, i b JOIN rk a ON a.series_id = b.series_id AND a.k < b.k WHERE a.k >= b.k - w GROUP BY ALL),
er AS (SELECT w, count(*) AS n, avg(abs(v - p)) AS mae FROM rk JOIN pr ON pr.series_id = rk.series_id AND pr.k = rk.k AND pr.h = rk.h GROUP BY 1),
hp AS (SELECT x.series_id, x.d, x.pos, x.price, pred_full, pred_alt, max(p) FILTER (w = 3) AS p3, max(p) FILTER (w = 5) AS p5, max(p) FILTER (w = 7) AS p7 FROM placed x LEFT JOIN pr ON pr.series_id = x.series_id AND pr.day = x.d AND pr.h = hour({B('x.t')}) GROUP BY ALL),
od AS (SELECT series_id, d FROM hp GROUP BY 1, 2 HAVING bool_and(p3 IS NOT NULL AND p5 IS NOT NULL AND p7 IS NOT NULL)),
pl AS (SELECT hp.series_id, hp.d, pos, price, s, CASE s WHEN 'S1' THEN pred_full WHEN 'S2' THEN pred_alt WHEN 'p3' THEN p3 WHEN 'p5' THEN p5 ELSE p7 END AS f FROM hp JOIN od ON od.series_id = hp.series_id AND od.d = hp.d, (SELECT unnest(['S1', 'S2', 'p3', 'p5', 'p7']) AS s)),
pp AS (SELECT a.series_id, a.d, a.s, a.price AS p_i, b.price AS p_j, a.pos AS i, b.pos AS j, {ad.ETA} * b.f - a.f - {ad.C} * (1 + {ad.ETA}) AS score FROM pl a JOIN pl b ON a.series_id = b.series_id AND a.d = b.d AND a.s = b.s AND a.pos < b.pos),
pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, d, s ORDER BY score DESC, i, j) AS rn FROM pp) WHERE rn = 1),
pt2 AS (SELECT s, sum(CASE WHEN score > 0 THEN {ad.ETA} * p_j - p_i - {ad.C} * (1 + {ad.ETA}) ELSE 0 END) AS x FROM pb GROUP BY 1),
tot AS (SELECT max(x) FILTER (s = 'S1') AS base, max(x) FILTER (s = 'S2') AS most FROM pt2)"""
register("rep_profile_window_table", "window_days:i n:i mae:f pnl:f full_minus:f gain:f share_of_gain:f", _profile_windows,
         f"{_PROFILES} ;; SELECT w AS window_days, n, mae, x AS pnl, most - x AS full_minus, x - base AS gain, "
         f"CASE WHEN most <> base THEN (x - base) / (most - base) END AS share_of_gain FROM er LEFT JOIN pt2 ON pt2.s = 'p' || w, tot")


def _recorded(s: SparkSession, d: str, odd: bool) -> DataFrame:
    """What runs recorded: rows of each series, of all events or of those with an odd id."""
    rows = ad.events(s, d).where(F.col("event_id") % 2 == 1) if odd else ad.events(s, d)
    return rows.groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("rows"), F.count_distinct(F.date_trunc("day", "ts")).alias("days")).selectExpr("run", "stack(2, "
        "'rows', cast(rows AS string), 'days', cast(days AS string)) AS (field, value)")


register("chk_lineage", "run:s field:s value:s found:s", lambda s, d: checks.lineage(_recorded(s, d, True), _recorded(s, d, False)),
         "g AS (SELECT event_type AS run, count(*) AS a, count(*) FILTER (event_id % 2 = 1) AS b, count(DISTINCT date_trunc('day', ts)) AS c, "
         "count(DISTINCT date_trunc('day', ts)) FILTER (event_id % 2 = 1) AS e FROM events GROUP BY 1) ;; SELECT * FROM (SELECT run, 'rows' AS field, "
         "a::VARCHAR AS value, b::VARCHAR AS found FROM g UNION ALL SELECT run, 'days', c::VARCHAR, e::VARCHAR FROM g) WHERE value <> found")
