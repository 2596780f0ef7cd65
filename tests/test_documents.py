"""Fields of documents by no schema."""

from pyspark.sql import functions as F

from tidemark.operators import documents as docs

XML = """<?xml version="1.0"?><!-- c --><D xmlns="urn:a" xmlns:b="urn:b"><mRID>007</mRID><empty/><blank>  </blank><b:head unit="x"><v> 1 </v><v>2</v></b:head>
<TimeSeries><mRID>s</mRID><new><kind><![CDATA[<k>]]></kind></new><Period><resolution>PT15M</resolution></Period></TimeSeries><tail>t</tail>
<TimeSeries><mRID>u</mRID></TimeSeries></D>"""


def test_fields_of_any_name(spark):
    table = spark.createDataFrame([(1, XML), (2, None), (3, ""), (4, "no xml <"), (5, "<D/>"), (6, "<D>text</D>")], "n int, xml string")
    got = [tuple(r) for r in docs.flatten_fields(table, ["n"]).orderBy("n", "place").select("n", "ts_index", "path", "text").collect()]
    assert got == [
        (1, None, "mRID", "007"), (1, None, "head.v", "1"), (1, None, "head.v", "2"), (1, 0, "mRID", "s"), (1, 0, "new.kind", "<k>"), (1, None, "tail", "t"), (1, 1, "mRID", "u"),
    ]
    assert docs.flatten_fields(table.limit(0), ["n"]).count() == 0


def series(sequence, body):
    return f"<TimeSeries><classificationSequence_AttributeInstanceComponent.position>{sequence}</classificationSequence_AttributeInstanceComponent.position>{body}</TimeSeries>"


def test_a_field_that_no_code_knows_shows_in_the_diff(spark):
    same = "<a>1</a><b>x</b><b>y</b>"
    rows = [
        (1, series(1, same) + series(2, same)),
        (2, series(1, same) + series(2, same + "<odd><z>9</z></odd>")),
        (3, series(1, same) + series(2, "<a>1</a><b>y</b><b>x</b>")),
        (4, series(1, same) + series(2, "<a>2</a>") + series(2, "<a>3</a>")),  # ambiguous
        (5, series(1, same) + series(3, "<a>2</a>")),  # no second sequence
        (6, series(1, same) + series(2, "<a>1</a><b>x</b>")),
    ]
    table = spark.createDataFrame([(n, f"<D>{x}</D>") for n, x in rows], "n int, xml string")
    got = {(r["n"], r["path"], tuple(r["texts_a"]), tuple(r["texts_b"])) for r in docs.field_diff(docs.paths(table, ["n"]), ["n"]).collect()}
    assert got == {(2, "odd.z", (), ("9",)), (3, "b", ("x", "y"), ("y", "x")), (6, "b", ("x", "y"), ("x",))}
    counts = docs.sequence_diff(docs.paths(table, ["n"]), ["n"]).where("n = 2").collect()
    assert [(r["path"], r["text"], r["n_a"], r["n_b"]) for r in counts] == [("odd.z", "9", 0, 1)]
    assert docs.paths(table.withColumn("xml", F.lit("broken <")), ["n"]).count() == 0
