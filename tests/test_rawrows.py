"""Raw rows, their fields, and corpora that follow a source, on small tables."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import fields as N
from kinweave.operators import rawrows


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_fields(spark):
    x = F.col("x")
    assert values(spark, N.doi(x), ["10.1000/AbC,", "doi:  10.1000/x more", "https://doi.org/10.1000/y; 10.2000/z", "junk", None, "10.1000/a;b"]) == ["10.1000/abc", "10.1000/x", "10.1000/y", "", "", "10.1000/a;b"]
    assert values(spark, N.timestamp(x), ["2020-01-02", "2020-01-02T03:04:05+02:00", "2020-01-02 03:04:05.5", "Mon, 2 Apr 2007 19:18:42 GMT", "bad", "", None]) == [
        "2020-01-02T00:00:00.000000+00:00", "2020-01-02T01:04:05.000000+00:00", "2020-01-02T03:04:05.500000+00:00", "2007-04-02T19:18:42.000000+00:00", "", "", "",
    ]
    assert values(spark, N.publication_year(x), ["2014", " 2015 ", "2014.5", "", None, "x"]) == [2014, 2015, 0, 0, 0, 0]
    assert values(spark, N.number(x, 7.0), ["1.5", "x", None]) == [1.5, 7.0, 7.0]
    assert values(spark, N.length_bucket(x), ["", "a b c", "x" * 40, "ab"]) == [0, 3, 10, 1]
    assert values(spark, N.categories(x), ["cs.CL, cs.LG cs.CL", "", None]) == [["cs.CL", "cs.LG"], [], []]
    assert values(spark, N.web_link(x), [" https://a.b/c ", "javascript:x", "ftp://a", None]) == ["https://a.b/c", "", "", ""]
    assert values(spark, N.edge_weight(F.col("w")), [1.5, -1.0, float("nan"), float("inf"), None], "w double") == [1.5, 1e-6, 1e-6, 1e-6, 1e-6]
    assert values(spark, N.quoted(x, "/"), ["a b*~/é+"]) == ["a%20b%2A~/%C3%A9%2B"]
    assert values(spark, N.reference_id(x), ['"p1"', '{"paper_id": "p2"}', '{"paper": {"paperId": "p3"}}', "{}", None]) == ["p1", "p2", "p3", None, None]


@pytest.mark.parametrize(("full", "short", "same"), [
    ("john ronald tolkien", "j r tolkien", True), ("john tolkien", "j tolkien", True), ("john tolkien", "k tolkien", False), ("john tolkien", "tolkien", False),
    ("ludwig van beethoven", "l van beethoven", True), ("john smith jr", "j smith jr", True), ("john smith jr", "j jr", False), ("j", "j s", False), ("", "j smith", False), ("john smith", "", False),
])
def test_abbreviated_names(spark, full, short, same):
    row = spark.createDataFrame([(full.split(), short.split())], "a array<string>, b array<string>").select(N.abbreviates(F.col("a"), F.col("b"))).first()
    assert row[0] is same


def test_structured_authors_win(spark):
    rows = [("A, B", [["Lee", " Ann ", ""], ["", "", ""]]), ("A, , B", [["", ""]]), ("A", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, t array<array<string>>")
    assert [r[0] for r in df.select(N.authors(F.col("a"), F.col("t"))).collect()] == [["Ann Lee"], ["A", "B"], ["A"], []]


def test_newest_version_wins(spark):
    rows = [("2101.00001v1", "2020-01-01", 0, "a"), ("2101.00001v2", "2020-01-01", 1, "b"), ("2101.00001", "2019-01-01", 2, "c"), (None, None, 3, "d"), (None, None, 4, "d"), ("x", None, 5, "e"), ("x", None, 6, "f")]
    raw = spark.createDataFrame(rows, "id string, update_date string, ordinal int, title string").withColumns({
        **{c: F.lit(None).cast("string") for c in ("abstract", "summary", "venue", "authors", "categories", "doi", "year")},
        "authors_parsed": F.lit(None).cast("array<array<string>>"), "versions": F.lit(None).cast("array<struct<version:string,created:string>>"),
    })
    chosen = rawrows.selected(rawrows.normalized(raw)).collect()
    assert [r["ordinal"] for r in chosen] == [1, 3, 6] and chosen[1]["id"].startswith("content:")
    assert [r["ordinal"] for r in rawrows.selected(rawrows.normalized(raw), 1).collect()] == [1]


def test_broken_stores_are_told(spark):
    members = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    whole = rawrows.certificate(members, members, 3)
    assert rawrows.require(whole, "complete", "corpus isn't complete").first()["complete"]
    broken = rawrows.certificate(members, spark.createDataFrame([(1,), (1,), (2,)], "id int"), 3)
    assert (broken.first()["dangling"], broken.first()["repeated"]) == (1, 1)
    with pytest.raises(Exception, match="corpus isn't complete"):
        rawrows.require(broken, "complete", "corpus isn't complete").collect()


def test_roles_and_bibliography(spark):
    store = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 2, [0.0, 1.0]), (4, 3, [0.1, 0.9])], "id int, row_idx int, vector array<double>")
    rows = {r["id"]: (r["rank_document"], r["rank_query"], r["best"]) for r in rawrows.two_roles(store, [1.0, 0.0], [0.0, 1.0], 2, F.col("id") != 1).collect()}
    assert rows == {2: (1, None, 1), 4: (2, 2, 2), 3: (None, 1, 1)}
    found = store.select("id", "vector", F.col("row_idx").alias("pos"))
    assert {r["id"] for r in rawrows.with_bibliography(store.limit(0).select("id"), found, [0.0, 1.0], 2).collect()} == {3, 4}
    assert {(r["id"], r["origin"]) for r in rawrows.with_bibliography(store.where("id = 1").select("id"), found, [0.0, 1.0], 2).collect()} == {(1, "provider")}
