"""The driver's tables as the records that the operators work on. Attributes that the tables lack are derived from their keys, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Records with vectors: evidence and years follow from the key.
PAPERS_SQL = """
SELECT vec_id AS id, vec_id AS row_idx, CAST(embedding AS DOUBLE[]) AS vector, label,
       CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(1990 + vec_id % 35 AS INT) END AS year,
       CASE WHEN vec_id % 7 = 0 THEN 0 ELSE (vec_id * 37) % 500 END AS citations,
       vec_id % 6 = 1 AS is_reference, vec_id % 10 = 2 AS cites_focal,
       CASE WHEN vec_id % 9 = 4 THEN CAST(vec_id // 9 AS INT) END AS recommendation_rank,
       CAST(vec_id % 5 AS INT) AS contexts, vec_id % 13 = 5 AS influential,
       [vec_id % 97, (vec_id * 7) % 97, (vec_id + label) % 97, label] AS refs, [label, label % 3] AS categories
FROM embeddings
"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        v.alias("id"), v.alias("row_idx"), F.col("embedding").cast("array<double>").alias("vector"), "label",
        F.when(v % 11 != 0, (1990 + v % 35).cast("int")).alias("year"), F.when(v % 7 == 0, 0).otherwise((v * 37) % 500).alias("citations"),
        (v % 6 == 1).alias("is_reference"), (v % 10 == 2).alias("cites_focal"), F.when(v % 9 == 4, F.floor(v / 9).cast("int")).alias("recommendation_rank"),
        (v % 5).cast("int").alias("contexts"), (v % 13 == 5).alias("influential"),
        F.array(v % 97, (v * 7) % 97, (v + F.col("label")) % 97, F.col("label").cast("long")).alias("refs"), F.array("label", F.col("label") % 3).alias("categories"),
    )


#: Works that are cited, with the orders that cite them.
WORKS_SQL = """
SELECT p_partkey AS id, p_name AS title, [p_brand, p_type] AS authors, p_type AS venue, CAST(1975 + p_size AS INT) AS year, coalesce(n, 0) AS citations, p_partkey = 1 AS is_focal,
       CASE WHEN p_size % 3 = 0 THEN 'semantic' WHEN p_size % 3 = 1 THEN 'citation' ELSE 'both' END AS source
FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey
"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    size = F.col("p_size")
    return read(spark, sf_dir, "part").join(cited, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.col("p_type").alias("venue"), (1975 + size).cast("int").alias("year"),
        F.coalesce("n", F.lit(0)).alias("citations"), (F.col("p_partkey") == 1).alias("is_focal"),
        F.when(size % 3 == 0, "semantic").when(size % 3 == 1, "citation").otherwise("both").alias("source"),
    )


def focal_vector(papers: DataFrame, key: int) -> list[float]:
    row = papers.where(F.col("id") == key).select("vector").first()
    if row is None:
        raise ValueError(f"record {key} isn't in the store")
    return row[0]
