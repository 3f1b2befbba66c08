"""Best-fit packing of documents into sequences of one length, by sum of squares.

Documents become token ids where they lie. One that is longer than a sequence is cut into pieces:
all but the first fill a sequence each. The other pieces, as rows of their lengths, are dealt to
groups of bounded size; a group places each piece where the sum of the squared numbers of open
sequences per gap becomes smallest, or opens a new one for it if that is smaller still.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codelode.llm.common import with_text_columns
from codelode.llm.tokens import byte_encoder
from codelode.sources.scratch import saved

CAPACITY = 1024
#: Id put behind each document.
END_ID = 2
#: Pieces of this share of a sequence, or more, go first; the short ones then fill the gaps.
LONG = 0.4
#: Pieces that are packed together.
GROUP_ROWS = 50_000


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids. Only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenized(docs: DataFrame, text_col: str = "text", path: str | None = None,
              capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True,
              drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``pieces``: an array of (piece, start, length, ids_crc32, ids). A null text
    counts as empty, which is one piece with the end id alone. ``ids`` is null unless asked for."""
    def make():
        encode = byte_encoder(path)

        def pieces(text: str | None) -> list[dict]:
            ids = np.array([*encode(text or ""), end_id], dtype="<u4")
            return [{"piece": i, "start": s, "length": n,
                     "ids_crc32": zlib.crc32(ids[s:s + n].tobytes()),
                     "ids": ids[s:s + n].tolist() if with_ids else None}
                    for i, (s, n) in enumerate(piece_bounds(len(ids), capacity))]

        return lambda texts: {"pieces": [pieces(t) for t in texts]}

    return with_text_columns(
        docs, text_col, make, "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long,"
        "ids:array<int>>>", drop)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Number of the sequence of each piece, and its offset there, pieces in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    n = 0
    for i, length in enumerate(lengths.tolist()):
        gap, change = capacity, 2 * count[capacity - length] + 1 if length < capacity else -1
        if length < capacity:
            if count[length] and 1 - 2 * count[length] <= change:
                gap, change = length, 1 - 2 * count[length]
            own = count[length + 1:capacity]
            moved = np.where(own > 0, 2 * (count[1:capacity - length] - own) + 2, 1 << 40)
            best = int(moved.argmin()) if len(moved) else -1
            if best >= 0 and moved[best] < change:
                gap = length + 1 + best
        if gap == capacity:
            at, n = n, n + 1
        else:
            at = open_[gap].pop()
            count[gap] -= 1
        if gap > length:
            open_[gap - length].append(at)
            count[gap - length] += 1
        bins[i], offsets[i] = at, capacity - gap
    return bins, offsets


def pack(pieces: DataFrame, key: list[str], n_pieces: int, capacity: int = CAPACITY,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to ``capacity``) with ``sequence_id`` and
    ``offset``. Pieces are dealt to groups by a hash of ``key``; ``n_pieces``, their number, says to
    how many. A group has about ``group_rows`` rows, whatever the sources and sizes, and takes its
    pieces in the order of ``key``, which should be random; the long ones first."""
    groups = max(1, -(-n_pieces // group_rows))
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = StructType([*fields, StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])
    dealt = pieces.select(*[f.name for f in fields]).withColumn(
        "__group", F.pmod(F.xxhash64(F.lit("pack"), *key), F.lit(groups)))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        group = int(batch["__group"].iloc[0])
        batch = batch.assign(__short=batch["length"] < LONG * capacity).sort_values(
            ["__short", *key], kind="stable")
        bins, offsets = sum_of_squares(batch["length"].to_numpy(), capacity)
        return batch.drop(columns=["__group", "__short"]).assign(
            sequence_id=bins + (group << 32), offset=offsets)

    return dealt.groupBy("__group").applyInPandas(run, schema)


def packed(docs: DataFrame, text_col: str = "text", with_ids: bool = True,
           **options) -> DataFrame:
    """One row per piece, with the columns of ``docs`` but for the text: piece, start, length,
    ids_crc32, ids, sequence_id, offset.

    Null texts count as empty. Repeated rows are packed as often as they occur, an empty table gives
    no rows; columns of ``docs`` with the names of new ones are replaced.
    """
    fields = ("piece", "start", "length", "ids_crc32", "ids")
    new = (*fields, "sequence_id", "offset", "pieces")
    rest = [c for c in docs.columns if c not in (text_col, *new)]
    rows = tokenized(docs.select(*rest, F.col(text_col).alias("__text_in")), "__text_in",
                     with_ids=with_ids, drop=("__text_in",), **options)
    pieces = rows.select(*rest, F.explode("pieces").alias("p")).select(
        *rest, *[f"p.{f}" for f in fields if with_ids or f != "ids"])
    pieces = saved(pieces, "pieces")
    spread = F.xxhash64(*[F.col(c) for c in pieces.columns if c != "ids"])
    return pack(pieces.withColumn("__key", spread), ["__key"], pieces.count(),
                options.get("capacity", CAPACITY)).drop("__key")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces; a sequence has at most the capacity's ids."""
    return (pieces.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids")))


def packing_report(docs: DataFrame) -> DataFrame:
    return packed(docs.select("doc_id", "text"), with_ids=False)
