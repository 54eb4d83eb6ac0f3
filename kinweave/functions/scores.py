"""Similarities of two records, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years, gates, weights, bonus and thresholds of the scores. Weights are of text or cosine, time, citations and shared references; of the embedding score of cosine, time and categories.
TEMPORAL_THRESHOLD = 5
EMBEDDING_GATE, EMBEDDING_WEIGHTS, AUTHOR_BONUS = 0.74, (0.5, 0.2, 0.2), 1.5
CITATION_WEIGHTS, CITATION_WITHOUT_REFERENCES = (0.40, 0.20, 0.0, 0.40), (0.65, 0.20, 0.15, 0.0)
RECOMMENDATION_WEIGHTS, RECOMMENDATION_WITHOUT_REFERENCES = (0.60, 0.15, 0.0, 0.25), (0.75, 0.25, 0.0, 0.0)
HYBRID_SEMANTIC, HYBRID_CITATION, HYBRID_MIXED = (0.6, 0.2, 0.1, 0.1), (0.3, 0.3, 0.2, 0.2), (0.4, 0.3, 0.2, 0.1)
EMBEDDING_EDGE, HYBRID_EDGE, HYBRID_FOCAL_EDGE, HYBRID_OTHER_EDGE = 0.1, 0.2, 0.4, 0.5


def temporal(a: Column, b: Column) -> Column:
    """0.5 if a year is missing, 0.1 beyond five years, else falling from 1 by 0.8 over five years."""
    d = F.abs(a - b)
    return F.when(d.isNull(), 0.5).when(d > TEMPORAL_THRESHOLD, 0.1).otherwise(1.0 - d / float(TEMPORAL_THRESHOLD) * 0.8)


def citation(a: Column, b: Column) -> Column:
    """Closeness of two counts on a log scale; 0.3 if either is zero."""
    x, y = F.log10(a + 1), F.log10(b + 1)
    return F.when((a > 0) & (b > 0), 1.0 - F.abs(x - y) / F.greatest(x, y)).otherwise(0.3)


def coupling(a: Column, b: Column) -> Column:
    """Shared over the root of the product of sizes, on distinct references; 0 if either list is empty."""
    x, y = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x > 0) & (y > 0), F.size(F.array_intersect(a, b)) / F.sqrt((x * y).cast("double"))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def indexed(text: Column, time: Column, cites: Column, shared: Column, both: Column, with_references: tuple[float, ...], without: tuple[float, ...], cap: bool = False) -> Column:
    """Weighted sum with one weight set where both records have references; 0 if neither text nor references speak for the pair."""

    def total(w: tuple[float, ...]) -> Column:
        return F.lit(w[0]) * text + F.lit(w[1]) * time + F.lit(w[2]) * cites + F.lit(w[3]) * shared

    score = F.when(both, total(with_references)).otherwise(total(without))
    score = F.when((text <= 0) & (shared <= 0), 0.0).otherwise(score)
    return F.least(score, F.lit(1.0)) if cap else score


def citation_strategy(text: Column, time: Column, cites: Column, shared: Column, both: Column) -> Column:
    return indexed(text, time, cites, shared, both, CITATION_WEIGHTS, CITATION_WITHOUT_REFERENCES)


def recommendation_strategy(text: Column, time: Column, cites: Column, shared: Column, both: Column) -> Column:
    return indexed(text, time, cites, shared, both, RECOMMENDATION_WEIGHTS, RECOMMENDATION_WITHOUT_REFERENCES, cap=True)


def embedding_strategy(cosine: Column, time: Column, categories: Column, shared_author: Column, gate: float = EMBEDDING_GATE) -> Column:
    """0 below the gate; else a weighted sum, raised by half for a shared author, 1 at most."""
    w = EMBEDDING_WEIGHTS
    score = F.lit(w[0]) * cosine + F.lit(w[1]) * time + F.lit(w[2]) * categories
    score = F.when(shared_author, score * AUTHOR_BONUS).otherwise(score)
    return F.when(cosine < gate, 0.0).otherwise(F.least(score, F.lit(1.0)))


def default_edge(score: Column, threshold: float = 0.0) -> Column:
    return (score > 0) & (score >= threshold)


def embedding_edge(score: Column) -> Column:
    return score > EMBEDDING_EDGE


def hybrid_edge(score: Column, focal: Column) -> Column:
    return (score >= HYBRID_EDGE) & (score > F.when(focal, HYBRID_FOCAL_EDGE).otherwise(HYBRID_OTHER_EDGE))


def hybrid_strategy(cosine: Column, time: Column, cites: Column, shared: Column, source_a: Column, source_b: Column, gate: float = EMBEDDING_GATE) -> Column:
    """Weights by where the two records came from (semantic, citation or both); 0 if neither cosine nor references speak for the pair."""
    meaning = source_a.isin("semantic", "both") & source_b.isin("semantic", "both")
    cited = source_a.isin("citation", "both") & source_b.isin("citation", "both")

    def total(w: tuple[float, ...]) -> Column:
        return F.lit(w[0]) * cosine + F.lit(w[1]) * time + F.lit(w[2]) * cites + F.lit(w[3]) * shared

    score = F.when(meaning & ~cited, total(HYBRID_SEMANTIC)).when(cited & ~meaning, total(HYBRID_CITATION)).otherwise(total(HYBRID_MIXED))
    return F.when((cosine < gate) & (shared <= 0), 0.0).otherwise(F.least(score, F.lit(1.0)))
