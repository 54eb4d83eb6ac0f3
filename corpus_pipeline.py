"""A corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, jaccard, pii, toxicity, wumanber
from kinweave.llm.common import checkpointed, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    return toxicity.score(docs, read(spark, sf_dir, "labels"), row=True).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return wumanber.decontaminate(docs, read(spark, sf_dir, "benchmark"), row=True).where("NOT contaminated").select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by marks of their kind; n_chars follows."""
    found = pii.find(docs, row=True)
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("redacted")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as token ids, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encode_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("bpe", tokenize),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else checkpointed(docs), sf_dir)
    return docs
