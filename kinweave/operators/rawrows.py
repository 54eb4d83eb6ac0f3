"""Raw rows of a source as records, and what keeps a stored corpus in step with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import fields as N
from kinweave.functions import ids as I
from kinweave.functions import vectors as V
from kinweave.operators import knn


def normalized(raw: DataFrame) -> DataFrame:
    """One record of each raw row: id, title, abstract, venue, arxiv, doi, year, authors, categories, chronology, ordinal and priority.

    raw: id, title, abstract, summary, one or more of venue, journal_ref, journal-ref and journal, authors (text), authors_parsed (rows of last, first, suffix), categories
    (text), doi, year (text), update_date, versions, ordinal. A row without an identifier is named by its content; id is null if it has no text either.
    """
    c = {n: F.col(f"`{n}`") for n in raw.columns}
    abstract, people, found = N.first_filled(c["abstract"], c["summary"]), N.authors(c["authors"], c["authors_parsed"]), N.doi(c["doi"])
    rows = raw.select(
        N.canonical_id(c["id"]).alias("stated"), F.when(F.trim("title") != "", c["title"]).otherwise("Unknown").alias("title"), F.coalesce("title", F.lit("")).alias("raw_title"),
        abstract.alias("abstract"), N.first_filled(*[c[k] for k in N.VENUE_KEYS if k in c]).alias("venue"), F.coalesce(found, F.lit("")).alias("doi"),
        N.year(c["year"], N.canonical_id(c["id"])).alias("year"), people.alias("authors"), N.categories(c["categories"]).alias("categories"),
        N.priority(c["update_date"], c["versions"], c["id"]).alias("priority"), "ordinal",
    )
    rows = rows.withColumn("id", F.coalesce("stated", N.content_id(F.col("raw_title"), F.col("abstract"), F.col("authors"), F.col("year"), F.col("doi"))))
    own = I.namespaces(F.col("id"))
    return rows.select("id", "title", "abstract", "venue", own["arxiv"].alias("arxiv"), F.coalesce(F.nullif("doi", F.lit("")), own["doi"]).alias("doi"), "year", "authors", "categories", I.chronology(F.col("id")).alias("chronology"), "ordinal", "priority")


def payload(rows: DataFrame) -> Column:
    """What a record says, but for where it stood: it decides between rows of the same priority."""
    return F.to_json(F.struct(*sorted(c for c in rows.columns if c not in ("ordinal", "priority"))))


def selected(rows: DataFrame, n: int | None = None) -> DataFrame:
    """One record of each id, that of the greatest priority and then payload, the first of equals; all or the ``n`` newest, in order of their ordinals."""
    best = rows.withColumn("payload", payload(rows)).groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("priority", "payload", -F.col("ordinal"))).alias("r")).select("r.*")
    if n is not None:
        dated = F.col("chronology").isNotNull()
        best = best.orderBy((~dated).cast("int"), F.desc("chronology"), F.when(dated, -F.col("ordinal")).otherwise(F.col("ordinal"))).limit(n)
    return best.orderBy("ordinal")


def retained(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Members, (id, ordinal) pairs, that are chosen still."""
    return members.join(chosen.select("id", "ordinal").distinct(), ["id", "ordinal"], "left_semi")


def unfinished(chosen: DataFrame, stored: DataFrame) -> DataFrame:
    """Chosen rows that a broken run didn't store."""
    return chosen.join(stored.select("id"), "id", "left_anti")


def refreshed(stored: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Stored rows with the source's metadata, and whether that changed anything; vectors stay."""
    new = source.select("id", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("met"))
    joined = stored.join(new, "id", "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    met = F.coalesce("met", F.lit(False))
    kept = [F.when(met, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns]
    return joined.select(*kept, (met & changed).alias("changed"))


def certificate(members: DataFrame, rows: DataFrame, examined: int) -> DataFrame:
    """One row: examined, members, stored, dangling, repeated, and whether the corpus is complete: every member is stored once, and none is made up."""
    counts = members.join(rows.groupBy("id").agg(F.count("*").alias("n")), "id", "left").agg(
        F.count("*").alias("members"), F.sum(F.when(F.col("n").isNotNull(), 1).otherwise(0)).alias("stored"), F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).alias("dangling"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"),
    )
    whole = (F.col("dangling") == 0) & (F.col("repeated") == 0) & (F.col("members") <= F.col("examined"))
    return counts.withColumn("examined", F.lit(examined).cast("long")).withColumn("complete", F.coalesce(whole, F.lit(True)))


def require(checked: DataFrame, passed: str, message: str) -> DataFrame:
    """``checked``, whose rows raise where the condition fails."""
    return checked.withColumn(passed, F.when(F.col(passed), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def saturation(writes: DataFrame, warn: float = 0.005) -> DataFrame:
    """Clipped and all values up to each write, their ratio, and whether the write by itself clipped so many that one should warn. writes: batch, clipped, total."""
    from pyspark.sql import Window as W

    # Batches are few: they are counts of writes, not of rows.
    upto = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    return writes.select("batch", F.sum("clipped").over(upto).alias("clipped"), F.sum("total").over(upto).alias("total"), (F.col("clipped") >= warn * F.col("total")).alias("warns")).withColumn("ratio", F.col("clipped") / F.col("total"))


def gathered(wanted: DataFrame, store: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vectors of the wanted physical rows, decoded to length 1, with their records and the number of records that claim the row.

    A row that no record claims, or more than one, is an error of the store; ``owners`` tells. store: row_idx, codes, ranges; metadata: id, row_idx.
    """
    owners = metadata.groupBy("row_idx").agg(F.count("*").alias("owners"), F.min("id").alias("id"))
    rows = wanted.select("row_idx").distinct().join(store.select("row_idx", "codes", "ranges"), "row_idx")
    unit = V.normalized(V.dequantized(F.col("codes"), F.col("ranges")))
    return rows.join(owners, "row_idx", "left").select("id", "row_idx", F.coalesce("owners", F.lit(0)).alias("owners"), unit.alias("vector"))


def in_view(wanted: DataFrame, store: DataFrame, view: DataFrame) -> DataFrame:
    """Stored rows of the wanted ids that the active view holds."""
    return store.join(view.select("id"), "id", "left_semi").join(wanted.select("id").distinct(), "id", "left_semi")


def two_roles(store: DataFrame, document: list[float], query: list[float], k: int, eligible: Column | None = None) -> DataFrame:
    """The k nearest eligible rows in either role, once: id, rank_document, rank_query and best, the smaller of them. Rows that aren't eligible take no place."""
    rows = store if eligible is None else store.where(eligible)

    def role(vector: list[float], name: str) -> DataFrame:
        near = knn.exact(rows, vector, k).select("id", "score").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("l"))
        return near.select(F.posexplode("l").alias("p", "e")).select(F.col("e.id").alias("id"), (F.col("p") + 1).alias(name))

    both = role(document, "rank_document").join(role(query, "rank_query"), "id", "full_outer")
    return both.withColumn("best", F.least("rank_document", "rank_query"))


def with_bibliography(given: DataFrame, found: DataFrame, focal: list[float], limit: int) -> DataFrame:
    """A record's own references, or, if the provider gave none, those that its bibliography led to, at most ``limit`` of them.

    given: id; found: id, vector, pos. Of more than ``limit`` the nearest to the focal record stay, by cosine and then place in the list.
    """
    own = given.agg((F.count("*") > 0).alias("own"))
    scored = found.withColumn("score", F.coalesce(V.cosine(F.col("vector"), knn.literal(focal)), F.lit(-1.0))).orderBy(F.desc("score"), "pos").limit(limit)
    recovered = scored.crossJoin(F.broadcast(own)).where("NOT own").select("id", F.lit("bibliography").alias("origin"))
    return given.select("id", F.lit("provider").alias("origin")).unionByName(recovered)


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges with the smaller end first, in order of their ends."""
    return edges.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "weight").orderBy("left", "right")
