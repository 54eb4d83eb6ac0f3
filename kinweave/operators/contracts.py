"""What rows, graphs and collections must be: rules told in one pass, with counts and first offenders, and raised by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "rule string, broken long, first string"


@dataclass(frozen=True)
class Rule:
    """A name and what is true of a row that breaks it; null isn't."""

    name: str
    broken: Column


def told(rows: DataFrame, rules: list[Rule], offender: Column, *by: str) -> DataFrame:
    """(by..., rule, broken, first): how many rows break each rule that is broken, and the least ``offender`` of them. All rules are one aggregate."""
    parts = []
    for n, r in enumerate(rules):
        bad = F.coalesce(r.broken, F.lit(False))
        parts += [F.count_if(bad).alias(f"n{n}"), F.min(F.when(bad, offender.cast("string"))).alias(f"f{n}")]
    one = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{n}").alias("broken"), F.col(f"f{n}").alias("first")) for n, r in enumerate(rules)])
    return rows.groupBy(*by).agg(*parts).select(*by, F.inline(one)).where("broken > 0")


def require(violations: DataFrame, what: str) -> None:
    """Raises ValueError with the broken rules, if there are any; a few of them are named."""
    found = violations.orderBy(*[c for c in violations.columns if c not in ("broken", "first")]).limit(20).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(", ".join(f"{v}" for v in r) for r in found))


def canonical_token(x: Column) -> Column:
    """Text that isn't empty and has no white space around it."""
    return F.coalesce((x != "") & (x == F.regexp_replace(x, r"^\s+|\s+$", "")), F.lit(False))


def graph_violations(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, rule, broken, first) of graphs (graph, focal, strategy, nodes, edges), their nodes (graph, id) and edges (graph, left, right, weight).

    Ids are canonical and stand once, ends and the focal record are nodes, no edge is a loop or stands twice, weights are between 0 and 1, counts are as stated, and every node and edge is of a graph. Nodes and ends meet by
    graph and id, where they are counted, so a node with many edges is one row of each task.
    """
    named = nodes.select("graph", "id", F.lit(1).alias("node"), F.lit(0).alias("end"), F.lit(0).alias("focal"))
    ends = edges.select("graph", F.explode(F.array("left", "right")).alias("id"), F.lit(0).alias("node"), F.lit(1).alias("end"), F.lit(0).alias("focal"))
    focals = graphs.select("graph", F.col("focal").alias("id"), F.lit(0).alias("node"), F.lit(0).alias("end"), F.lit(1).alias("focal"))
    met = named.unionByName(ends).unionByName(focals).groupBy("graph", "id").agg(*[F.sum(c).alias(c) for c in ("node", "end", "focal")])
    token = canonical_token(F.col("id"))
    by_id = told(met, [
        Rule("node id isn't canonical", (F.col("node") > 0) & ~token), Rule("node id stands more than once", F.col("node") > 1), Rule("edge has no node", (F.col("end") > 0) & (F.col("node") == 0)),
        Rule("focal record isn't a node", (F.col("focal") > 0) & (F.col("node") == 0)),
    ], F.coalesce("id", F.lit("")), "graph")
    w = F.col("weight")
    pairs = edges.groupBy("graph", F.least("left", "right").alias("l"), F.greatest("left", "right").alias("r")).agg(F.count("*").alias("n"), F.count_if(~F.coalesce((w >= 0) & (w <= 1) & ~F.isnan(w), F.lit(False))).alias("odd"))
    by_edge = told(pairs, [Rule("edge is a loop", F.col("l").eqNullSafe(F.col("r"))), Rule("edge stands more than once", F.col("n") > 1), Rule("weight isn't between 0 and 1", F.col("odd") > 0)], F.concat_ws(" - ", "l", "r"), "graph")
    counts = nodes.groupBy("graph").agg(F.count("*").alias("n")).withColumn("m", F.lit(0).cast("long")).unionByName(edges.groupBy("graph").agg(F.count("*").alias("m")).withColumn("n", F.lit(0).cast("long"))).groupBy("graph").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    stated = graphs.withColumn("stated", F.lit(True)).join(counts, "graph", "full_outer").fillna(0, ["n", "m"])
    by_graph = told(stated, [
        Rule("graph isn't stated", F.col("stated").isNull()), Rule("strategy isn't canonical", F.col("stated") & ~canonical_token(F.col("strategy"))),
        Rule("nodes aren't as many as stated", F.col("stated") & ~F.col("nodes").eqNullSafe(F.col("n"))), Rule("edges aren't as many as stated", F.col("stated") & ~F.col("edges").eqNullSafe(F.col("m"))),
    ], F.col("graph"), "graph")
    return by_id.unionByName(by_edge).unionByName(by_graph)


def kind_of(payload: Column, field: str) -> Column:
    """The kind of a field of a parsed payload: its SQL type, ``VOID`` for null, null if it isn't there."""
    return F.schema_of_variant(F.try_variant_get(payload, f"$.{field}", "variant"))


def typed_records(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``raw`` with record (id, title, abstract, year, citations, authors, doi, arxiv) and fault: the first rule that a provider's JSON breaks. Where there is a fault the record is null.

    A payload without an id that is text has neither. Titles and abstracts are text, years whole numbers, citation counts whole numbers, and authors objects with a name that is text and an id that is text or null; each may be absent or null, a title, abstract
    or count also another empty value. A payload that isn't an object of JSON is a fault.
    """
    v = F.try_parse_json(F.col(payload))
    rows = raw.withColumn("v_", v)
    get = lambda f, t: F.try_variant_get("v_", f"$.{f}", t)
    kind = lambda f: F.coalesce(kind_of(F.col("v_"), f), F.lit("VOID"))
    empty = lambda f: (kind(f) == "VOID") | ((kind(f) == "BOOLEAN") & (get(f, "boolean") == False)) | ((kind(f) == "BIGINT") & (get(f, "bigint") == 0)) | (kind(f).isin("ARRAY<VOID>", "OBJECT<>"))  # noqa: E712, E731
    text = lambda f: empty(f) | (kind(f) == "STRING")
    authors = get("authors", "array<variant>")
    author = lambda a, f: F.coalesce(F.schema_of_variant(F.try_variant_get(a, f"$.{f}", "variant")), F.lit("VOID"))
    odd = F.exists(authors, lambda a: ~F.schema_of_variant(a).startswith("OBJECT") | (author(a, "name") != "STRING") | ~author(a, "authorId").isin("VOID", "STRING"))
    named = (kind("paperId") == "STRING") & (get("paperId", "string") != "")
    fault = (
        F.when(F.col("v_").isNull() | ~F.schema_of_variant(F.col("v_")).startswith("OBJECT"), "payload isn't an object").when(~named, F.lit(None))
        .when(~text("title"), "title isn't text").when(~kind("year").isin("VOID", "BIGINT"), "year isn't a whole number").when(~(empty("citationCount") | (kind("citationCount") == "BIGINT")), "citationCount isn't a whole number")
        .when(~text("abstract"), "abstract isn't text").when((kind("authors") != "VOID") & authors.isNull(), "authors aren't a list").when(F.coalesce(odd, F.lit(False)), "an author isn't as it should be")
    )
    filled = lambda f, other: F.coalesce(F.when(kind(f) == "STRING", F.nullif(get(f, "string"), F.lit(""))), F.lit(other))
    names = F.coalesce(F.filter(F.transform(authors, lambda a: F.trim(F.try_variant_get(a, "$.name", "string"))), lambda n: n != ""), F.array().cast("array<string>"))
    record = F.struct(
        get("paperId", "string").alias("id"), filled("title", "Unknown").alias("title"), filled("abstract", "").alias("abstract"), get("year", "int").alias("year"), F.greatest(F.coalesce(F.when(kind("citationCount") == "BIGINT", get("citationCount", "bigint")), F.lit(0)), F.lit(0)).alias("citations"),
        names.alias("authors"), F.lower(get("externalIds.DOI", "string")).alias("doi"), get("externalIds.ArXiv", "string").alias("arxiv"),
    )
    both = rows.withColumn("fault", fault)
    return both.withColumn("record", F.when(F.col("fault").isNull() & named, record)).drop("v_")


def strict_records(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The records of payloads that name one; a payload that breaks a rule raises, with the rule."""
    rows = typed_records(raw, payload)
    checked = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("a provider's record is wrong: "), F.col("fault"))).cast(rows.schema["record"].dataType)).otherwise(F.col("record"))
    return rows.select(checked.alias("record")).where("record IS NOT NULL").select("record.*")


COLLECTION = "kind string, version int, current string, results array<struct<result_id: string, focal: string, strategy: string, title: string, updated: string>>"


def collection_violations(packages: DataFrame, kind: str, version: int, package: str = "package") -> DataFrame:
    """(package, rule, broken, first) of collections of results (see COLLECTION), by the name of each."""
    p = packages
    head = told(p, [
        Rule("kind isn't known", ~F.col("kind").eqNullSafe(F.lit(kind))), Rule("version isn't known", ~F.col("version").eqNullSafe(F.lit(version))), Rule("results aren't a list", F.col("results").isNull()),
        Rule("current result isn't there", (F.coalesce(F.trim("current"), F.lit("")) != "") & ~F.coalesce(F.array_contains(F.transform("results", lambda r: r["result_id"]), F.trim("current")), F.lit(False))),
    ], F.col(package), package)
    rows = p.select(package, F.posexplode_outer("results").alias("pos", "r")).where("pos IS NOT NULL").select(package, "pos", "r.*")
    each = told(rows, [
        *[Rule(f"{c} isn't canonical", ~canonical_token(F.col(c))) for c in ("result_id", "focal", "strategy")], Rule("result_id isn't strategy and focal record", F.col("result_id") != F.concat("strategy", F.lit(":"), "focal")),
        Rule("updated isn't a time", F.col("updated").isNull() | F.try_to_timestamp("updated").isNull()),
    ], F.format_string("%08d", "pos"), package)
    return head.unionByName(each)


def collection_results(packages: DataFrame, package: str = "package") -> DataFrame:
    """The results of collections, the first of each result_id, in their order."""
    rows = packages.select(package, F.posexplode("results").alias("pos", "r")).select(package, "pos", "r.*")
    first = rows.groupBy(package, "result_id").agg(F.min_by(F.struct("pos", "focal", "strategy", "title", "updated"), "pos").alias("r"))
    return first.select(package, "result_id", "r.*")


def differing(stated: Mapping[str, object], wanted: Mapping[str, object]) -> list[str]:
    """Fields in which a stored contract isn't the wanted one: absent, added or of another value."""
    return sorted(k for k in {*stated, *wanted} if k not in stated or k not in wanted or stated[k] != wanted[k])


def require_contract(stated: Mapping[str, object], wanted: Mapping[str, object]) -> None:
    """Stored vectors and corpora are used again only under the contract (model, text form, source, split, size) that they were made under."""
    if found := differing(stated, wanted):
        raise ValueError(f"the store was made under another contract: {', '.join(f'{k} is {stated.get(k)!r}, not {wanted.get(k)!r}' for k in found)}")


def unit_interval(value: object, name: str) -> float:
    """A parameter between 0 and 1."""
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        x = -1.0
    if isinstance(value, bool) or not 0 <= x <= 1:
        raise ValueError(f"{name} must be a number between 0 and 1")
    return x


def bounded(value: object, name: str, least: int, most: int | None = None) -> int:
    """A whole number within bounds."""
    if isinstance(value, bool) or not isinstance(value, (int, str)) or (isinstance(value, str) and not value.strip().lstrip("+-").isdigit()):
        raise ValueError(f"{name} must be a whole number")
    n = int(value)
    if n < least or (most is not None and n > most):
        raise ValueError(f"{name} must be {least} or more" + (f" and {most} or less" if most is not None else ""))
    return n
