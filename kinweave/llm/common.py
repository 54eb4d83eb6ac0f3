"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.session import ship

#: A document word: a run of digits, ASCII letters (after lower-casing A-Z) and every character from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z and nothing else.
FOLD = str.maketrans(UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Only a local master may do without one that the session names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: its rows are written to the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which the shuffle files of a query are removed as soon as it ends, rather than when the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the session's checkpoint folder: it cuts the lineage as well, is packed, and is read by column. The shuffle files behind it are removed."""
    path, conf = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANED)
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Code points of a block of a text that is read in many places.
BLOCK = 1024


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK code points. A place in a string is found by counting from its start, so many places of a long one are read from these."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in blocks."""
    a, z = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    first, last = start.cast("int") % BLOCK, end.cast("int") % BLOCK
    part = lambda b: F.coalesce(F.get(blocks, b), F.lit(""))
    inside = F.substring(part(a), first + 1, last - first)
    return F.when(a == z, inside).otherwise(F.concat(F.substring(part(a), first + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, a + 2, F.greatest(z - a - 1, F.lit(0))), ""), F.substring(part(z), F.lit(1), last)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """What an associative ``step`` makes of all values before each place of an array, and of all of them at the end: one entry more than values.

    An array that grows by one in a fold is copied each time, so the array is cut into about sqrt(n) blocks of that length, and
    n ** 1.5 entries are copied.
    """
    kinds = f"array<{kind}>"

    def fold(block: Column, begin: Column) -> Column:
        return F.aggregate(block, F.struct(begin.cast(kind).alias("at"), F.array().cast(kinds).alias("out")), lambda a, x: F.struct(step(a["at"], x).cast(kind).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def cut(v: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / w).cast("int")), lambda b: F.slice(v, b * w + 1, w)))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, start.cast(kind), lambda a, x: step(a, x).cast(kind)))
        before = let(fold(totals, start), lambda t: F.concat(t["out"], F.array(t["at"])))
        return let(before, lambda o: F.concat(F.flatten(F.transform(blocks, lambda b, i: fold(b, F.get(o, i))["out"])), F.array(F.element_at(o, -1))))

    return let(values, lambda v: let(cut(v), whole))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, ``row``, which passes through an operator beside its own columns, whatever their names are."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def arrow_rows(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | Iterable[dict] | None]], schema: str, rows: int = 500
) -> DataFrame:
    """``df`` through ``make()``, which is called once in each task and gives a function from a batch to columns (or to several sets of columns).

    A column of ``df`` named ``row`` is put behind the columns of a batch that gives one row for each of its rows.

    Batches are cut to ``rows`` rows, so that the memory of a Python worker is bounded by the longest texts and not by the table.
    """
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    with_schema = _parse_datatype_string(schema)
    carried = "row" in df.columns
    if carried:
        with_schema = with_schema.add(df.schema["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, step = to_arrow_schema(with_schema), make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step(part)
                for columns in [out] if isinstance(out, dict) else out or ():
                    if carried:
                        columns = columns | {"row": part.column(part.schema.get_field_index("row"))}
                    yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) and columns[f.name].type == f.type else pa.array(columns[f.name], f.type) for f in kind], schema=kind)
        for columns in getattr(step, "rest", tuple)():
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, with_schema)
