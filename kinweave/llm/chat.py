"""Chat formatting with Spark expressions only: collected turn structs are sorted, runs of one role are merged, and all is concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import between, blocks_of, let, read, running

#: A turn block is ``<|ROLE|>text<|end|>``; rows of one role that follow each other share a block, parted by ``<|and|>``.
#: Texts and roles can't hold ``<|``: a backslash is doubled first, then ``<|`` becomes ``<\|``. In roles ``|>`` becomes ``|\>`` too.
OPEN, CLOSE, END, AND = "<|", "|>", "<|end|>", "<|and|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("|>"), F.lit("|\\>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("|\\>"), F.lit("|>")))


def format_conversations(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, the [start, end) code points of the trained role's texts.

    Rows stand in order of turn; those of one turn in order of role and text, null turns first. Adjacent rows of one role are
    merged into one block by array aggregation: a block begins where the role changes, and holds the slice up to the next. Null roles and
    texts are empty, repeated rows stay, null ids are one conversation. Other columns aren't read. An empty table gives no rows. Each row of
    ``formatted`` is one conversation, which is as large as its texts; nothing else is gathered.
    """
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    changes = F.filter(F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())

    def block(begins: Column):
        def merged(i: Column, n: Column) -> Column:
            end = F.coalesce(F.get(begins, n + 1), F.size("turns"))
            texts = F.transform(F.slice("turns", i + 1, end - i), lambda t: escaped(t["text"]))
            return F.struct(F.get("turns", i)["role"].alias("role"), texts.alias("texts"))

        return F.transform(begins, merged)

    # pieces: the strings that are concatenated, and whether each is trained on. The first piece of a block holds its mark.
    def laid(b: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped_role(b["role"]), F.lit(CLOSE))
        mark = lambda s: F.struct(s.alias("s"), F.lit(False).alias("loss"))
        texts = F.transform(b["texts"], lambda t, i: F.array(mark(F.when(i == 0, head).otherwise(F.lit(AND))), F.struct(t.alias("s"), (b["role"] == trained_role).alias("loss"))))
        return F.concat(F.flatten(texts), F.array(mark(F.lit(END))))

    out = sorted_turns.select("conv_id", let(changes, block).alias("blocks")).select("conv_id", F.flatten(F.transform("blocks", laid)).alias("pieces"))
    kind = "array<struct<start:bigint,end:bigint>>"

    def spans(at: Column) -> Column:
        own = F.transform("pieces", lambda p, i: F.when(p["loss"], F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"))))
        return F.filter(own, lambda s: s.isNotNull()).cast(kind)

    places = running(F.transform("pieces", lambda p: F.length(p["s"]).cast("long")), F.lit(0), lambda a, x: a + x, "long")
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), let(places, spans).alias("loss_spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """The turns of ``format_conversations``' output, read back from its strings: conv_id, turns (role and text), loss_text, formatted."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, F.lit(CLOSE)) + F.lit(2), F.length(b)), r"<\|and\|>", -1),
                lambda t: F.struct(unescaped_role(F.substring(b, F.lit(3), F.instr(b, F.lit(CLOSE)) - F.lit(3))).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    loss = let(blocks_of(F.col("formatted")), lambda t: F.array_join(F.transform("loss_spans", lambda s: unescaped(between(t, s["start"], s["end"]))), ""))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(awkward).alias("text"))
    back = parse_conversations(format_conversations(rows.unionByName(extra)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), r AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
         length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2 AS text_chars,
         length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '<|', ''))) // 2 + (length(role) - length(replace(role, '|>', ''))) // 2 AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN before = role THEN 7 ELSE role_chars + 4 + 7 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
