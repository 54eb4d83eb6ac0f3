"""Licence scans by diagonal voting: word k-grams meet template positions in a join, and votes are added by offset. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import LOWER, UPPER, WORD, read, text_or_empty

#: The base phrases, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of well-known licences and notices, with the method's labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-notice",
    "licensed under the apache license version 2 0": "apache-line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-line",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "released under the mit license": "mit-line",
}
GRAM = 3


#: Rows of the template table up to which it is broadcast; a larger one is joined as Catalyst chooses.
SMALL = 200_000


def templates(spark: SparkSession, notices: dict[str, str]) -> tuple[DataFrame, bool]:
    """(k, w0, w1, w2, template, label, base, at, grams), one row for each k-gram of each template, w2 empty where k is 2; and whether the table is small.

    Phrases of two words are one 2-gram; all else is cut into GRAM-grams. Notices of one word say nothing and are left out.
    """
    rows = []
    for n, (body, label, base) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((p, x, False) for p, x in notices.items())]):
        w = body.split()
        k = min(GRAM, len(w))
        if k > 1:
            rows += [(k, w[i], w[i + 1], w[i + 2] if k > 2 else "", n, label, base, i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "k int, w0 string, w1 string, w2 string, template int, label string, base boolean, at int, grams int"), len(rows) <= SMALL


def rolled(before: Column, word: Column) -> Column:
    """A gram's hash with one word more: the hash so far is turned by a bit, and the word's hash is added bit by bit."""
    return F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(F.xxhash64(word))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = 0.6, apart: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score, places (label, base, first word, verified grams, share).

    The rolling hash of every word 2-gram and 3-gram is joined with the template positions that have it, and their words are
    compared. A match votes for the diagonal ``document word - template word``. Words that were put in or left out shift
    diagonals, so a diagonal with votes is merged with the ``apart`` next ones; it takes in no others, so a place is at most so many words
    longer than its template. The span is then verified: matches are read in the order of the document, and one counts if its template
    position is beyond all counted before it, so a gram that is repeated counts once, and grams in another order don't count.
    A place stands if the counted ones are ``coverage`` of its template's grams. A base phrase is one gram, and each match a
    place. score is the largest share that any place has of its template.

    Null and empty texts have no words and no places. Repeated rows and null keys are rows of their own. Other columns aren't
    read; an empty table gives no rows. Rows grow with the matches, and no more than ``apart`` + 1 times GRAM-grams of a template fall to one place.
    """
    spark = docs.sparkSession
    grams, small = templates(spark, NOTICES if notices is None else notices)
    words = F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs[key].cast("long").alias("key"), words.alias("w"))
    n = F.size("w")
    after = lambda k: F.when(n > k, F.slice("w", k + 1, n)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("uid", "key", n.alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), after(1).alias("b"), after(2).alias("c"))).alias("pos", "g"))
    rows = rows.select("uid", "key", "n_words", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"))
    rows = rows.withColumn("h2", rolled(F.xxhash64("a"), F.col("b"))).withColumn("h3", rolled(F.col("h2"), F.col("c")))

    def matched(left: DataFrame, k: int) -> DataFrame:
        w = ("w0", "w1", "w2")[:k]
        # One row for each gram, with all the positions that it has, so that a document position stays one row.
        part = grams.where(F.col("k") == k).groupBy(*w).agg(F.collect_list(F.struct("template", "label", "base", "grams", "at")).alias(f"m{k}"))
        hashed = F.xxhash64("w0")
        for x in w[1:]:
            hashed = rolled(hashed, F.col(x))
        part = part.select(hashed.alias(f"hash{k}"), *[F.col(x).alias(f"{x}_{k}") for x in w], f"m{k}")
        same = F.col(f"h{k}") == F.col(f"hash{k}")
        for x, y in zip(("a", "b", "c")[:k], ("w0", "w1", "w2"), strict=False):
            same = same & (F.col(x) == F.col(f"{y}_{k}"))
        return left.join(F.broadcast(part) if small else part, same, "left").drop(f"hash{k}", *[f"{x}_{k}" for x in ("w0", "w1", "w2")[:k]])

    both = matched(matched(rows, 2), 3)
    none = F.array().cast("array<struct<template:int,label:string,base:boolean,grams:int,at:int>>")
    votes = both.select("uid", "key", "n_words", "pos", F.explode_outer(F.concat(F.coalesce("m2", none), F.coalesce("m3", none))).alias("m"))
    diagonal = F.col("pos") - F.col("m.at")
    # A vote goes to its own diagonal and to those up to ``apart`` before it, which it may be merged with.
    to = F.when(F.col("m.base"), F.array(diagonal)).when(F.col("m").isNotNull(), F.sequence(diagonal - apart, diagonal))
    votes = votes.select("uid", "key", "n_words", "pos", "m", diagonal.alias("own"), F.explode_outer(to).alias("diagonal"))
    per = votes.groupBy("uid", "key", "n_words", F.col("m.template").alias("template"), F.col("m.label").alias("label"), F.col("m.base").alias("base"), F.col("m.grams").alias("grams"), "diagonal")
    per = per.agg(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("pos", F.col("m.at").alias("at"))))).alias("votes"), F.max(F.col("own") == F.col("diagonal")).alias("voted"))
    ordered = F.aggregate(
        "votes", F.struct(F.lit(-1).alias("top"), F.lit(0).alias("n")),
        lambda s, v: F.struct(F.greatest(s["top"], v["at"]).alias("top"), (s["n"] + (v["at"] > s["top"]).cast("int")).alias("n")), lambda s: s["n"],
    )
    per = per.withColumn("n", ordered).withColumn("share", F.col("n") / F.col("grams"))
    stands = F.col("template").isNotNull() & F.col("voted") & (F.col("base") | (F.col("share") >= coverage))
    place = F.struct("label", "base", F.get("votes", F.lit(0))["pos"].alias("first"), F.col("n").cast("long").alias("votes"), "share")
    found = per.groupBy("uid", "key", "n_words").agg(F.array_sort(F.collect_list(F.when(stands, place))).alias("places"))
    starts = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["first"])
    names: Column = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["label"])
    return found.select(
        F.col("key").alias(key), F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("places")


def sql(notices: dict[str, str], coverage: float = 0.6, apart: int = 3) -> str:
    rows = [(n, p, x, "true") for n, (p, x) in enumerate(PHRASES.items())] + [(n + len(PHRASES), p, x, "false") for n, (p, x) in enumerate(notices.items())]
    values = ", ".join(f"({n}, string_split('{p}', ' '), '{x}', {b})" for n, p, x, b in rows)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents
), t(template, w, label, base) AS (VALUES {values}),
g AS (
  SELECT template, label, base, least(len(w), {GRAM}) AS k, len(w) - least(len(w), {GRAM}) + 1 AS grams, i - 1 AS tpos, array_to_string(w[i : i + least(len(w), {GRAM}) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {GRAM}) + 2)) AS i FROM t)
), p AS (
  SELECT uid, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), v AS (SELECT uid, template, label, base, grams, pos, tpos, pos - tpos AS diagonal FROM p JOIN g USING (k, gram)),
own AS (SELECT DISTINCT uid, template, base, diagonal FROM v),
near AS (
  SELECT own.uid, own.template, own.diagonal, v.label, v.base, v.grams, v.pos, v.tpos,
         max(v.tpos) OVER (PARTITION BY own.uid, own.template, own.diagonal ORDER BY v.pos, v.tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM own JOIN v ON own.uid = v.uid AND own.template = v.template AND v.diagonal BETWEEN own.diagonal AND own.diagonal + CASE WHEN own.base THEN 0 ELSE {apart} END
), m AS (SELECT uid, template, diagonal, label, base, grams, min(pos) AS first, count(*) FILTER (WHERE top IS NULL OR tpos > top) AS n FROM near GROUP BY ALL),
ok AS (SELECT *, CAST(n AS DOUBLE) / grams AS share FROM m WHERE base OR CAST(n AS DOUBLE) / grams >= {coverage}),
a AS (
  SELECT uid, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM ok GROUP BY uid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (uid)
"""


OP3_SQL = sql(NOTICES)
