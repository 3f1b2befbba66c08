"""Helpers that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codelode.sources.scratch import saved

#: A word of a text, as Java and Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are put into Python lists at once.
ROWS_AT_ONCE = 256
#: Most rows of a table that is broadcast. Its rows are at most 100 bytes or so.
BROADCAST_ROWS = 200_000

TextFunction = Callable[[list[str | None]], dict[str, object]]


def bounded(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table of narrow rows, marked for broadcast when its row count allows that; else
    as it is, so that a join with it shuffles both sides."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def with_text_columns(df: DataFrame, text: str, make: Callable[[], TextFunction], schema: str,
                      drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns worked out in Python from one text column, batch by batch and without a
    shuffle. ``make`` runs once per task and gives a function from a list of texts to lists of
    values by column. New columns replace old ones of the same name; ``drop`` leaves out input
    columns."""
    new = StructType.fromDDL(schema)
    keep = [f for f in df.schema.fields if f.name not in set(new.names) | set(drop)]
    types = to_arrow_schema(new)
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                columns = part.columns
                got = work(columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    columns[:-1] + [pa.array(got[f.name], type=f.type) for f in types],
                    names=[f.name for f in keep] + new.names)

    return source.mapInArrow(run, StructType(keep + new.fields))


def row_hash(text: Column) -> Column:
    """Second part of a row's key beside its id, for tables in which ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions(id, row_hash, kept, rows)`` keeps, and one row where
    ``rows`` equal ones stay. Only rejected and repeated keys, narrow rows, are joined: texts
    move only when these are too many to broadcast."""
    decisions = saved(decisions, "decisions")
    keyed = docs.withColumn("__hash", row_hash(F.col(text_col)))
    same = lambda d: F.col(id_col).eqNullSafe(d["__id"]) & (F.col("__hash") == d["__h"])
    named = decisions.select(F.col(id_col).alias("__id"), F.col("row_hash").alias("__h"),
                             "kept", "rows").distinct()
    gone = named.where(~F.col("kept") | (F.col("rows") > 1)).select("__id", "__h")
    gone = saved(gone.distinct(), "gone")
    out = keyed.join(bounded(gone), same(gone), "left_anti")
    several = named.where(F.col("kept") & (F.col("rows") > 1)).select("__id", "__h").distinct()
    if not several.isEmpty():
        several = saved(several, "several")
        out = out.unionByName(keyed.join(bounded(several), same(several), "left_semi")
                              .dropDuplicates([id_col, "__hash"]))
    return out.drop("__hash")
