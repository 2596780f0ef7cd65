"""Queries on tables larger than the given ones, made by repeating rows with shifted keys."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import documents as docs

SMALL = "/root/testdata/sf0.001"


def repeated(spark, folder, times):
    """``SMALL``'s events ``times`` times, at the same times under other ids."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    again = events.crossJoin(spark.range(times).withColumnRenamed("id", "k"))
    again.withColumn("event_id", F.col("event_id") + F.col("k") * 1_000_000).drop("k").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def sql_rows(folder, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con.sql(__spark_entry__.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("name", ["cln_dedupe", "aud_sequence_diff"])
def test_repeated_events_give_the_rows_of_the_sql(spark, tmp_path, name):
    folder = repeated(spark, tmp_path, 3)
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()]
    want = sql_rows(folder, name)
    assert got and sorted(got, key=str) == sorted(want, key=str)


def test_dedupe_refuses_other_readings_of_the_same_times(spark, tmp_path):
    """Copies of a reading are one; readings that differ at more than 1 % of rows' times are a selection that is missing."""
    again = spark.read.parquet(f"{repeated(spark, tmp_path / 'copies', 2)}/events.parquet")
    value = F.when((F.col("event_id") > 1_000_000) & (F.col("event_id") % 10 == 0), F.col("value") + 1).otherwise(F.col("value"))
    again.withColumn("value", value).write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(ValueError, match="repeat"):
        __spark_entry__.queries()["cln_dedupe"](spark, str(tmp_path)).collect()


def test_documents_are_not_parsed_below_what_makes_them(spark):
    """A filter that is inferred from the parsed document must not be pushed to the rows that a document is grouped from."""
    made = spark.range(1000).groupBy((F.col("id") % 3).alias("n")).agg(F.lit(1)).select("n", F.concat(F.lit("<D><mRID>"), F.col("n").cast("string"), F.lit("</mRID></D>")).alias("xml"))
    plan = docs.paths(made, ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "from_xml" in plan
    assert "from_xml" not in plan[plan.index("Aggregate"):].split("\n", 1)[1]
