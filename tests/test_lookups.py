"""Lookups, order of recovered references, collections and small fields."""

from pyspark.sql import functions as F

from kinweave.functions import fields, ids, text
from kinweave.operators import evidence, identity, pool, references
from kinweave.sources import files


def test_a_focal_record_is_found_outside_the_view(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("C", 3)], "id string, n int")
    aliases = spark.createDataFrame([("a", "arxiv:1"), ("b", "10.1/X"), ("b", "both"), ("a", "both"), ("C", "a")], "id string, alias string")
    look = lambda name: [r["id"] for r in identity.focal_record(rows, aliases, name).collect()]
    assert (look("a"), look("arxiv:1"), look("10.1/x"), look("both"), look("none")) == (["a"], ["a"], ["b"], [], [])


def test_recovered_references_by_score_citations_and_place(spark):
    rows = spark.createDataFrame([(1, 0.5, 3, 0), (2, 0.9, 0, 1), (3, 0.5, 9, 2), (4, 0.5, 9, 3)], "id long, score double, citations long, pos long")
    assert [r["id"] for r in pool.recovered(rows, 3).collect()] == [2, 3, 4]


def test_collections_keep_one_graph_of_each_strategy_and_focal_record(spark):
    kind = "strategy string, focal string, payload string"
    stored, new = spark.createDataFrame([("s", "a", "old"), ("t", "a", "kept")], kind), spark.createDataFrame([("s", "a", "new"), ("s", "b", "added")], kind)
    assert sorted(map(tuple, files.collection_upsert(stored, new).collect())) == [("s", "a", "new"), ("s", "b", "added"), ("t", "a", "kept")]


def test_small_fields(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(ids.arxiv_of_path(F.lit(p))) for p in ("/abs/2101.00001v2", "/pdf/2101.00001.pdf", "/abs/hep-th/9901001", "/")] == ["2101.00001", "2101.00001", "hep-th/9901001", None]
    assert one(fields.share_authors(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) and not one(fields.share_authors(F.array(F.lit("a")), F.lit(None).cast("array<string>")))
    assert one(text.count_or_zero(F.lit("12"))) == 12 and one(text.count_or_zero(F.lit("-3"))) == 0 and one(text.count_or_zero(F.lit(None).cast("string"))) == 0


def test_references_of_several_records(spark):
    kind = "id string, title string, author string, year int, arxiv string, doi string, text string, citations long"
    records = spark.createDataFrame([(f"r{i}", "t", "a", 2000, f"2101.0000{i}", None, t, c) for i, (t, c) in enumerate([("red apple pie", 1), ("blue sky", 5), ("red apple", 2), ("green sea", 5), ("own text", 0)])], kind)
    focals = spark.createDataFrame([("f", "x", "2101.00004", None, "a red apple"), ("g", "y", None, None, "sky"), ("h", "r1", None, None, "z")], "focal string, id string, arxiv string, doi string, text string")
    entry = "focal string, entry int, identifiers array<string>, title string, author string, year int"
    entries = spark.createDataFrame([("f", n, [f"arxiv:2101.0000{i}"], None, None, None) for n, i in enumerate([3, 1, 0, 2, 4, 3])] + [("g", 0, ["arxiv:2101.00001"], None, None, None), ("h", 0, ["arxiv:2101.00001"], None, None, None), ("h", 1, ["arxiv:2101.00002"], None, None, None)], entry)
    provider = spark.createDataFrame([("g", 2, "p2"), ("g", 1, "p1"), ("other", 1, "q")], "focal string, pos long, id string")
    got = {}
    for r in references.references(provider, entries, records, focals, 2).orderBy("focal", "pos").collect():
        got.setdefault(r["focal"], []).append((r["id"], r["origin"]))
    assert got == {"f": [("r2", "bibliography"), ("r0", "bibliography")], "g": [("p1", "provider"), ("p2", "provider")], "h": [("r2", "bibliography")]}


def test_evidence_is_read_back_as_it_was(spark, tmp_path):
    nodes = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, False), (2, "semantic", None, 1, 0.5, 0.1, 0.2, None, {"semantic": 1}, "2101.00001", None, True)], "id long, source string, relation string, rank int, score double, cos_dd double, cos_q double, ctx double, list_ranks map<string,int>, arxiv string, doi string, local boolean")
    relevance = spark.createDataFrame([(1, 0.75)], "id long, relevance double")
    passages = spark.createDataFrame([(2, ["a", "b", "c"], True)], "id long, contexts array<string>, influential boolean")
    told = evidence.documents(nodes, relevance, passages, F.lit(1), "citation", 2)
    path = str(tmp_path / "e")
    evidence.written(told, path)
    rows = evidence.read_back(told, path).orderBy("id").collect()
    assert rows == told.orderBy("id").collect()
    focal, other = rows
    assert (focal["provenance"], focal["provenance_base"], focal["relation"], focal["reference_evidence"], focal["discovery"], focal["relevance"]) == ("focal", "citation", "focal", None, None, 0.75)
    assert (other["provenance"], other["relation"], other["reference_evidence"]["contexts"], other["reference_evidence"]["n_passages"], other["discovery"]["rank"], other["links"]["provider"]) == ("semantic", "semantic_only", ["a", "b"], 3, 1, None)
