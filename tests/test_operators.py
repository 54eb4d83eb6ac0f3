"""Operators on small tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import ids as I
from kinweave.functions import scores as S
from kinweave.functions import text as T
from kinweave.functions import vectors as V
from kinweave.operators import corpus, graph, identity, knn, ranking
from kinweave.sources import files, tables
from kinweave.streaming import upserts


def values(spark, columns, rows, expression):
    df = spark.createDataFrame(rows, columns)
    return [r[0] for r in df.select(expression).collect()]


def greedy(edges, cap, focal=None, priority=()):
    """The walk that ``graph.capped`` must agree with."""
    strong = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    at_focal = [e for e in strong if focal in e[:2]]
    first = [e for e in at_focal if set(e[:2]) & set(priority)]
    second = [e for e in at_focal if not set(e[:2]) & set(priority)]
    turns = []
    for k in range(max(len(first), len(second))):
        turns += first[k : k + 1] + second[k : k + 1]
    degree, kept = {}, set()
    for a, b, _ in turns + [e for e in strong if focal not in e[:2]]:
        if degree.get(a, 0) < cap and degree.get(b, 0) < cap:
            kept.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return kept


@pytest.mark.parametrize(("seed", "cap", "focal"), [(1, 2, None), (2, 3, 0), (3, 1, 5)])
def test_capped_edges_are_those_of_a_greedy_walk(spark, seed, cap, focal):
    rnd = random.Random(seed)
    edges = [(a, b, rnd.choice([0.2, 0.4, 0.5, 0.9])) for a in range(14) for b in range(a + 1, 14) if rnd.random() < 0.6]
    df = spark.createDataFrame(edges, "left int, right int, weight double")
    priority = [1, 3, 7] if focal is not None else []
    wanted = spark.createDataFrame([(p,) for p in priority], "id int") if priority else None
    walked = graph.capped(df, cap, None if focal is None else F.lit(focal), wanted)
    found = graph.capped(df, cap, None if focal is None else F.lit(focal), wanted, small=0)
    assert sorted(walked.collect()) == sorted(found.collect())
    assert {(r["left"], r["right"]) for r in found.collect()} == greedy(edges, cap, focal, priority)


def test_no_cap_keeps_all_and_canonical_edges_keep_the_strongest(spark):
    df = spark.createDataFrame([("b", "a", 0.1), ("a", "b", 0.3), ("a", "a", 1.0)], "a string, b string, weight double")
    rows = graph.capped(graph.canonical(df), 0).collect()
    assert [tuple(r) for r in rows] == [("a", "b", 0.3)]


def test_graph_metrics(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 2.0)], "left int, right int, weight double")
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r["id"]: r["distance"] for r in graph.distances(nodes, edges, F.lit(0)).collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None}
    rank = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, F.lit(0)).collect()}
    assert all(abs(rank[r["id"]] - r["rank"]) < 1e-5 for r in graph.pagerank(nodes, edges, F.lit(0), small=0).collect())
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank[3] == 0 and rank[0] > rank[2] > 0
    group = {r["id"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert group[3] == group[4] != group[0] and len(group) == 6


def test_int8_codes_and_signs(spark):
    df = spark.createDataFrame([(0, 0, [-1.0, 0.0, 1.0]), (1, 1, [1.0, 0.5, -1.0])], "id int, row_idx int, vector array<double>")
    ranges = knn.calibration(df)
    rows = knn.encoded(df, ranges, 3).orderBy("id").collect()
    assert rows[0]["codes"][0] == -128 and rows[0]["codes"][2] == 127 and rows[0]["n_clipped"] == 0
    assert rows[0]["signs"] == [0b011] and rows[1]["signs"] == [0b110]
    assert values(spark, "a array<bigint>, b array<bigint>", [([5, 1], [6, 0])], V.hamming(F.col("a"), F.col("b"))) == [3]


def test_vectors_that_are_not_valid(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([None, 1.0],), ([1.0],), (None,)]
    assert values(spark, "v array<double>", rows, V.valid(F.col("v"), 2)) == [True, False, False, False, False, False]
    with pytest.raises(Exception, match="finite"):
        knn.exact(spark.createDataFrame([(1, 1, [float("nan")])], "id int, row_idx int, vector array<double>"), [1.0], 1).collect()


def test_scores(spark):
    years = [(2000, 2000), (2000, 2005), (2000, 2006), (None, 2000)]
    assert values(spark, "a int, b int", years, F.round(S.temporal(F.col("a"), F.col("b")), 6)) == [1.0, 0.2, 0.1, 0.5]
    assert values(spark, "a int, b int", [(0, 5), (9, 9)], S.citation(F.col("a"), F.col("b"))) == [0.3, 1.0]
    lists = [(["x", "y"], ["y", "z"]), ([], ["y"]), (["x", "x"], ["x"])]
    assert values(spark, "a array<string>, b array<string>", lists, S.coupling(F.col("a"), F.col("b"))) == [0.5, 0.0, 1.0]
    assert values(spark, "a array<string>, b array<string>", lists, F.round(S.jaccard(F.col("a"), F.col("b")), 6)) == [0.333333, 0.0, 1.0]


def test_rank_fusion_follows_the_lists(spark):
    schema = "id string, vector array<double>, is_reference boolean, cites_focal boolean, recommendation_rank int, contexts int, influential boolean"
    rows = [("a", [1.0, 0.0], True, False, None, 2, None), ("b", [0.0, 1.0], False, False, 1, None, None), ("c", [1.0, 1.0], False, True, None, None, None)]
    found = {r["id"]: r for r in ranking.rank_candidates(spark.createDataFrame(rows, schema), [1.0, 0.0], [0.0, 1.0]).collect()}
    assert found["a"]["list_ranks"] == {"semantic": 1, "direct": 1, "focal_reference": 1}
    assert abs(found["a"]["score"] - 2.5 / 61) < 1e-12 and found["a"]["rank"] == 1
    assert found["b"]["list_ranks"] == {"semantic": 3, "recommended": 1}
    assert found["a"]["ctx"] is None


def test_identifiers(spark):
    given = ["arXiv:2508.12345v2", "2508.12345", "hep-th/9901001", "https://arxiv.org/abs/2508.14040v1", "https://arxiv.org/pdf/hep-th/9901001.pdf", "https://doi.org/10.1000/ABC", "doi:10.48550/arXiv.2508.12345", " x1 "]
    rows = [(g,) for g in given]
    assert values(spark, "x string", rows, I.canonical(F.col("x"))) == ["arxiv:2508.12345", "2508.12345", "hep-th/9901001", "arxiv:2508.14040", "arxiv:hep-th/9901001", "10.1000/abc", "10.48550/arxiv.2508.12345", "x1"]
    assert values(spark, "x string", rows[:3], I.chronology(F.col("x"))) == [20250812345, 20250812345, 19990100001]
    assert values(spark, "x string", rows[6:7], I.arxiv_of_doi(F.col("x"))) == ["arxiv:2508.12345"]
    assert values(spark, "x string", [("2513.12345",), ("content:ab",), ("arxiv_12",)], I.chronology(F.col("x"))) == [None, None, None]
    pairs = [(("a", None), ("a", "d")), (("a", "c"), ("a", "d")), ((None, None), (None, None))]
    kind = "a struct<arxiv:string,doi:string>, b struct<arxiv:string,doi:string>"
    assert values(spark, kind, pairs, I.same_identity(F.col("a"), F.col("b"))) == [True, False, False]


def test_texts(spark):
    assert values(spark, "x string", [("Straße  ﬁne_x",), (None,)], T.folded_words(F.col("x"))) == ["strasse fine x", None]
    assert values(spark, "a string, b string", [("T", "A"), (" ", "A"), (None, " ")], T.composed(F.col("a"), F.col("b"))) == ["T. A", "A", None]
    assert values(spark, "x string", [("=1",), ("a=1",)], T.csv_guarded(F.col("x"))) == ["'=1", "a=1"]
    assert values(spark, "x string", [("a\\b&c",)], T.bibtex_escaped(F.col("x"))) == ["a\\textbackslash{}b\\&c"]
    assert values(spark, "x string", [("a\x01<b>&",)], T.xml_safe(F.col("x"))) == ["a&lt;b&gt;&amp;"]


def test_newest_rows_and_upserts(spark):
    rows = spark.createDataFrame([(1, 10, 0), (2, 10, 1), (3, None, 2), (4, None, 3), (5, 9, 4)], "id int, chronology int, ordinal int")
    assert [r["id"] for r in corpus.newest(rows, 4).collect()] == [2, 1, 5, 3]
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, text string")
    assert {r["id"]: r["action"] for r in corpus.upsert_plan(stored, new).collect()} == {1: "absent", 2: "replace", 3: "append"}
    assert sorted(tuple(r) for r in corpus.upserted(stored, new).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_aliases_are_unique_or_nothing(spark):
    aliases = spark.createDataFrame([("1", "X"), ("2", "x"), ("3", "Y"), ("4", "Z"), ("5", "Z")], "id string, alias string")
    wanted = spark.createDataFrame([("X",), ("y",), ("Z",), ("q",)], "name string")
    assert {r["name"]: r["id"] for r in identity.resolved(wanted, aliases).collect()} == {"X": "1", "y": "3", "Z": None, "q": None}


def test_bibliography_prefers_unique_keys_and_next_year_for_preprints(spark):
    entries = spark.createDataFrame([("e1", "t", "a", 2021), ("e2", "u", "a", 2021)], "entry string, title string, author string, year int")
    records = spark.createDataFrame([("r1", "t", "a", 2020, True), ("r2", "u", "a", 2020, False)], "id string, title string, author string, year int, preprint boolean")
    assert [tuple(r) for r in identity.bibliography_matches(entries, records).collect()] == [("e1", "r1")]


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("row_number"), F.concat(F.lit("p"), "id").alias("id"), F.array(F.lit(1).cast("tinyint")).alias("v"))
    files.write_snapshot(rows, str(tmp_path / "s"), shards=3, model="m")
    back = files.read_snapshot(spark, str(tmp_path / "s"), model="m")
    assert back.exceptAll(rows).count() == 0 and back.count() == 100
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "s"), model="other")
    rows.where("row_number <> 5").write.mode("overwrite").parquet(str(tmp_path / "s/rows"))
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "s"))


def test_graph_payload_round_trip(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, title string")
    edges = spark.createDataFrame([("a", "b", 0.5)], "left string, right string, weight double")
    n, e = files.read_graph(files.graph_payload(nodes, edges, "hybrid", "a"), "id:string,title:string")
    assert n.exceptAll(nodes).count() == 0 and e.exceptAll(edges).count() == 0
    lines = [r["line"] for r in files.graphml(nodes, edges).orderBy("part", "ord").collect()]
    assert len(lines) == 5 and 'target="b"' in lines[3]
    broken = spark.createDataFrame([("a", "c", 0.5)], "left string, right string, weight double")
    with pytest.raises(ValueError):
        files.read_graph(files.graph_payload(nodes, broken, "hybrid", "a"), "id:string,title:string")


def test_csv_has_the_fixed_columns(spark, tmp_path):
    import csv

    kind = "id string, title string, year int, authors array<string>, is_focal boolean, focal_relevance double, abstract string, extra int"
    nodes = spark.createDataFrame([("a", '=1+"2"', 2001, ["x", "y"], True, 0.25, "two\nlines, ", 1), ("b", None, None, None, None, None, None, 2)], kind).coalesce(1)
    files.write_csv(nodes, str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part-*"))
    with part.open(newline="") as f:
        head, first, second = list(csv.reader(f))
    assert tuple(head) == files.CSV_COLUMNS
    told = dict(zip(head, first, strict=True))
    assert (told["title"], told["year"], told["authors"], told["is_focal"], told["focal_relevance"], told["abstract"]) == ("'=1+\"2\"", "2001", "x; y", "true", "0.250000", "two\nlines, ")
    assert {c: v for c, v in zip(head, second, strict=True) if v} == {"id": "b", "citation_count": "0", "is_focal": "false", "focal_relevance": "0.000000"}
    assert files.csv_table(nodes.where("false")).count() == 0


def test_graphml_is_a_whole_document(spark, tmp_path):
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([("a", "A & <B>", 2001, ["x", "y"], True), ('b"', None, None, [], False)], "id string, title string, year int, `names, all` array<string>, is_focal boolean")
    edges = spark.createDataFrame([("a", 'b"', 1234.5)], "left string, right string, weight double")
    files.write_graphml(nodes, edges, str(tmp_path / "g"))
    root = ElementTree.fromstring("".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    names = {k.get("id"): (k.get("attr.name"), k.get("attr.type")) for k in root.findall(f"{ns}key")}
    found = {x.get("id"): {names[d.get("key")][0]: d.text for d in x} for x in root.iter(f"{ns}node")}
    assert found == {"a": {"title": "A & <B>", "year": "2001", "names, all": "x, y", "is_focal": "true"}, 'b"': {"names, all": None, "is_focal": "false"}}
    edge = next(root.iter(f"{ns}edge"))
    assert (edge.get("source"), edge.get("target"), edge[0].text, names[edge[0].get("key")]) == ("a", 'b"', "1234.5", ("weight", "double"))
    empty = files.graphml(nodes.where("false"), edges.where("false")).orderBy("part").collect()
    assert list(ElementTree.fromstring("\n".join(r["line"] for r in empty)).iter(f"{ns}node")) == []


def test_provider_records(spark):
    raw = ['{"paperId":"p1","title":"T","year":"2020","citationCount":"-3","authors":[{"name":" A B "},{"name":""}],"externalIds":{"DOI":"10.1/X"}}', '{"title":"no id"}', "broken"]
    rows = files.provider_records(spark.createDataFrame([(r,) for r in raw], "payload string")).collect()
    assert [(r["id"], r["year"], r["citations"], r["authors"], r["doi"]) for r in rows] == [("p1", 2020, 0, ["A B"], "10.1/x")]


def test_upsert_stream_equals_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, at int, text string")
    first.write.parquet(str(source))
    for batch in ([(2, 2, "c"), (2, 3, "d"), (3, 1, "e")], [(1, 9, "z")]):
        spark.createDataFrame(batch, first.schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(first.schema).parquet(str(source))
        upserts.upsert_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", ["at"]).awaitTermination()
    table = tables.opened(spark, str(tmp_path / "out")).read(spark)
    assert sorted((r["id"], r["text"]) for r in table.collect()) == [(1, "z"), (2, "d"), (3, "e")]
