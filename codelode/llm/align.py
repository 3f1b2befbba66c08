"""Alignment of two tokenizers over the same texts, by coalescing of byte intervals.

Both tokenizers' tokens are byte ranges of one text. All ranges of a batch of texts, one text behind
the other, are sorted by start (``lexsort``); the running maximum of their ends
(``maximum.accumulate``) tells where a group ends: where the next start reaches it. Inside a group the
ranges of A and B that overlap are expanded to pairs.

A pair of ids is linked where two ranges end together. How often each pair is, over all texts, is
summed from the texts' own sums. The pairs that hold more than a hundred-thousandth of all links, which
are 100,000 at most, are broadcast; the links of others, none of them frequent, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codelode.llm.tokens import byte_encoder, byte_token_bytes, piece_encoder
from codelode.sources.scratch import saved

#: Characters of texts that are aligned at once, and most texts of them.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 256
#: Most pairs that are broadcast: those with at least this fraction of all links.
FREQUENT = 100_000
COLUMNS = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "links array<struct<a:int,b:int,n:long>>")


def groups(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray,
           b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all ranges (those of A first, then those of B) by start, and in this order whether a
    range is the first of its group and which group it is in. Ranges are not empty."""
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    order = np.lexsort((ends, starts))
    first = np.ones(len(order), dtype=bool)
    first[1:] = starts[order][1:] >= np.maximum.accumulate(ends[order])[:-1]
    return order, first, np.cumsum(first) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray,
             b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the ranges of A and B that overlap. Each list is in order and its ranges do
    not overlap among themselves, so those of B that meet one of A are a run, inside its group."""
    low = np.searchsorted(b_ends, a_starts, "right")
    count = np.maximum(np.searchsorted(b_starts, a_ends, "left") - low, 0)
    i = np.repeat(np.arange(len(a_starts)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]


def _flat(parts: Sequence[Sequence[int]]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.asarray(p, dtype=np.int64) for p in parts)])


class Aligner:
    """Aligns lists of texts. A text that is null or empty, or that the tokens do not spell (behind
    one space), has no tokens."""

    def __init__(self, byte_path: str | None = None, piece_path: str | None = None) -> None:
        self.encode_a = byte_encoder(byte_path, plain=True)
        self.bytes_a = byte_token_bytes(byte_path)
        self.encode_b, self.bytes_b = piece_encoder(piece_path)
        self.lengths = [np.array([len(x) for x in d]) for d in (self.bytes_a, self.bytes_b)]
        #: an id as text, before another one of the group and before the end of its side of it
        self.names = [[np.array([f"{i}{mark}" for i in range(len(d))], dtype=object)
                       for mark in (",", end)] for d, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text."""
        pieces = self.encode_b([t or "" for t in texts])
        out = []
        for text, b in zip(texts, pieces, strict=True):
            a, data = [], b" " + (text or "").encode()
            if text and b"".join(map(self.bytes_b.__getitem__, b)) == data:
                a = self.encode_a(" " + text)
                if b"".join(map(self.bytes_a.__getitem__, a)) != data:
                    a = []
            out.append((a, b if a else []))
        return out

    def align(self, texts: list[str | None]) -> list[dict]:
        """Per text the ids of both sides, the groups as (a_first, a_end, b_first, b_end) by number
        of the token, and the overlapping pairs by number."""
        out = []
        for a, b in self.tokens(texts):
            ids, ranges = self._ranges([a], [b])
            order, first, group = groups(*ranges)
            sides = np.stack([np.bincount(group[order < len(a)], minlength=int(first.sum())),
                              np.bincount(group[order >= len(a)], minlength=int(first.sum()))])
            ends = np.cumsum(sides, axis=1)
            bounds = np.stack([ends[0] - sides[0], ends[0], ends[1] - sides[1], ends[1]], axis=1)
            out.append({"a": ids[0].tolist(), "b": ids[1].tolist(), "groups": bounds.tolist(),
                        "pairs": np.stack(overlaps(*ranges), axis=1).tolist()})
        return out

    def _ranges(self, a: list[list[int]], b: list[list[int]]):
        ids = [_flat(a), _flat(b)]
        ends = [np.cumsum(n[i]) for n, i in zip(self.lengths, ids, strict=True)]
        starts = [e - n[i] for e, n, i in zip(ends, self.lengths, ids, strict=True)]
        return ids, (starts[0], ends[0], starts[1], ends[1])

    def measures(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns ``COLUMNS`` for texts, all of them aligned at once, one behind the other."""
        made = self.tokens(texts)
        counts = np.array([(len(a), len(b)) for a, b in made], dtype=np.int64).reshape(-1, 2)
        (ids_a, ids_b), ranges = self._ranges([a for a, _ in made], [b for _, b in made])
        n_a = len(ids_a)
        text_of = [np.repeat(np.arange(len(texts)), counts[:, k]) for k in (0, 1)]
        order, first, group = groups(*ranges)
        owner = np.concatenate(text_of)[order]
        n_groups = np.bincount(owner[first], minlength=len(texts))

        is_b = order >= n_a
        named = np.lexsort((order, group))  # by group, A before B, each in its order
        order, group, is_b = order[named], group[named], is_b[named]
        last = np.ones(len(order), dtype=bool)
        last[:-1] = (group[1:] != group[:-1]) | (is_b[1:] != is_b[:-1])
        ids = np.concatenate([ids_a, ids_b])[order]
        words = np.empty(len(order), dtype=object)
        for side, names in enumerate(self.names):
            for end, table in enumerate(names):
                here = (is_b == bool(side)) & (last == bool(end))
                words[here] = table[ids[here]]
        ends = np.cumsum(counts.sum(axis=1)).tolist()
        digests = ["".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends)]
        digests = [sha256(d.encode()).hexdigest() if d else "" for d in digests]

        i, j = overlaps(*ranges)
        together = ranges[1][i] == ranges[3][j]
        i, j = i[together], j[together]
        n_links = np.bincount(text_of[0][i], minlength=len(texts))
        pair = ids_a[i] * len(self.bytes_b) + ids_b[j]
        pairs = len(self.bytes_a) * len(self.bytes_b)
        found, times = np.unique(text_of[0][i] * pairs + pair, return_counts=True)
        offsets = np.searchsorted(found, np.arange(len(texts) + 1) * pairs).astype(np.int32)
        a, b = np.divmod(found % pairs, len(self.bytes_b))
        links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(times)],
            names=["a", "b", "n"]))
        return [pa.array(counts[:, 0]), pa.array(counts[:, 1]), pa.array(n_groups), pa.array(n_links),
                pa.array(digests, type=pa.string()), links]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts that are aligned at once."""
    first, size = 0, 0
    for at, n in enumerate(pc.utf8_length(texts).fill_null(0).to_pylist()):
        if at > first and (size + n > CHARS_AT_ONCE or at - first == TEXTS_AT_ONCE):
            yield first, at
            first, size = at, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def aligned(docs: DataFrame, text_col: str = "text", byte_path: str | None = None,
            piece_path: str | None = None) -> DataFrame:
    """``docs`` without the text but with numbers of tokens (``n_a``, ``n_b``), groups and links,
    ``groups_sha256`` and ``links``: the linked pairs of ids and how often each is, in no order.

    A text that is null or empty, or that the tokens of either side do not spell, has no tokens: zeros,
    no links and ''. Columns of ``docs`` with the names of new ones are replaced, equal rows stay
    apart, an empty table gives no rows. Texts are taken whole, and several long ones never at once.
    """
    new = StructType.fromDDL(COLUMNS)
    keep = [f for f in docs.schema.fields if f.name not in {text_col, *new.names}]
    types = to_arrow_schema(new)
    source = docs.select(*[F.col(f"`{f.name}`") for f in keep],
                         F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            for first, end in _runs(batch.column(batch.num_columns - 1)):
                *rest, texts = batch.slice(first, end - first).columns
                made = aligner.measures(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    rest + [c.cast(f.type) for c, f in zip(made, types, strict=True)],
                    names=[f.name for f in keep] + new.names)

    return source.mapInArrow(run, StructType(keep + new.fields))


def pair_counts(links: DataFrame) -> DataFrame:
    """``links(a, b, n)`` summed: ``a``, ``b``, ``count`` and ``best``, whether no other pair of the
    same ``b`` has more. Saved."""
    counts = saved(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counts.groupBy(F.col("b").alias("__b")).agg(F.max("count").alias("__most"))
    return saved(counts.join(highest, F.col("b") == F.col("__b")).select(
        "a", "b", "count", (F.col("count") == F.col("__most")).alias("best")), "pairs")


def scored(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows of ``aligned`` without ``links``, with ``n_best`` (links whose pair is the most frequent of
    its id of B, ties included) and ``count_sum`` (the sum of the links' counts over all rows)."""
    rows = saved(rows.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("__row", F.explode("links").alias("l")).select("__row", "l.*")
    pairs = pair_counts(links)
    total = pairs.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * frequent >= total  # at most ``frequent`` pairs can have that many
    named = pairs.withColumnsRenamed({"a": "__a", "b": "__b"})
    same = (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b"))
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    known = links.join(F.broadcast(named.where(often)), same, "left")
    parts = known.where(F.col("count").isNotNull()).groupBy("__row").agg(*sums).unionByName(
        known.where(F.col("count").isNull()).select("__row", "a", "b", "n")
        .join(named.where(~often), same).groupBy("__row").agg(*sums))
    by_row = parts.groupBy(F.col("__row").alias("__r")).agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (rows.drop("links", "n_best", "count_sum").join(by_row, F.col("__row") == F.col("__r"), "left")
            .drop("__row", "__r")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}))


def alignment_report(docs: DataFrame) -> DataFrame:
    return scored(aligned(docs.select("doc_id", "text")))
