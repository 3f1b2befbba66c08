"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within 3 bits differ somewhere, so at least one difference lies in the first block
of 16 bits that has any. Without that block at most two differences are left, and the balls of
radius 1, half of that, around both fingerprints share a point. So each different fingerprint emits,
for each of the four blocks left out, all its variants within radius 1: 4 x 49 rows. They are
shuffled on the variant (48 bits and the block), pairs that collide are verified on all 64 bits, and a
pair counts at one agreed variant only, so no pair is seen twice.

Equal fingerprints are one node from the start; copies never form pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.llm.common import bounded, keep_rows, row_hash, with_text_columns
from codelode.llm.components import components
from codelode.sources.scratch import saved

#: Differing bits of linked fingerprints. The variants below are made for 3 (and hold for less).
RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = tuple(range(0, 64, 16))
#: Fingerprints whose variants one task makes.
PRINTS_PER_TASK = 20_000


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _mask(at: int) -> int:
    return ((1 << 64) - 1) ^ (0xFFFF << at)


#: What a fingerprint is masked and changed with: the block left out holds its own number.
VARIANTS = tuple((at, flip) for at in BLOCKS
                 for flip in (0, *(1 << bit for bit in range(64) if not at <= bit < at + 16)))


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """Hashes of all runs of ``size`` words; fewer words are one run, none give no hashes."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-size])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1:], strict=True)]


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles of a text, as a signed 64-bit number."""
    import numpy as np

    hashes = shingle_hashes(text, SHINGLE)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``fingerprint`` (long). No words: zero, like a null text."""
    return with_text_columns(
        docs, text_col, lambda: lambda texts: {"fingerprint": [fingerprint(t) for t in texts]},
        "fingerprint long", drop)


def _variants(prints: DataFrame) -> DataFrame:
    made = F.array(*[F.struct(F.lit(_signed(_mask(at))).alias("mask"),
                              F.lit(_signed(flip | ((at // 16 + 1) << at))).alias("change"))
                     for at, flip in VARIANTS])
    exploded = prints.select("fp", F.explode(made).alias("v"))
    return exploded.select("fp", F.col("fp").bitwiseAND(F.col("v.mask"))
                           .bitwiseXOR(F.col("v.change")).alias("variant"))


def _meeting(x: Column, y: Column) -> Column:
    """The one variant at which the pair counts: the first differing block is left out, and of two
    further differences ``x`` changes the lower one."""
    differ = x.bitwiseXOR(y)
    out = None
    for at in reversed(BLOCKS):
        mask = F.lit(_signed(_mask(at)))
        rest = differ.bitwiseAND(mask)
        lowest = rest.bitwiseAND(F.bitwise_not(rest) + 1)
        place = x.bitwiseAND(mask).bitwiseXOR(F.lit(_signed((at // 16 + 1) << at)))
        place = F.when(F.bit_count(rest) == 2, place.bitwiseXOR(lowest)).otherwise(place)
        inside = differ.bitwiseAND(F.lit(_signed(0xFFFF << at)))
        out = place if out is None else F.when(inside != 0, place).otherwise(out)
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of different values of ``fp`` that differ in at most ``radius`` bits. The
    narrow table of fingerprints is dealt out first, because each one makes 196 rows."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    prints = prints.repartition(-(-prints.count() // PRINTS_PER_TASK) or 1, "fp")
    one, two = (_variants(prints).select(F.col("fp").alias(n), F.col("variant").alias(f"v{n}"))
                for n in "ab")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # sizes are estimated before the explode, so a broadcast must be ruled out
    return one.hint("merge").join(two, (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")) & near
                    & (F.col("va") == _meeting(F.col("a"), F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long), ``component_id`` (the smallest
    id reachable over links; null only if all of these are null) and ``row_hash``.

    A null text has no words, and texts without words share fingerprint zero and are linked like any
    others. Equal ids are not merged: each row has its own fingerprint. Other columns are not looked
    at, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__t"),
                       row_hash(F.col(text_col)).alias("row_hash"))
    rows = saved(fingerprints(rows, "__t", drop=("__t",)), "fingerprints")
    prints = saved(rows.groupBy(F.col("fingerprint").alias("fp"))
                   .agg(F.min(id_col).alias("least")), "prints")
    found = components(links(prints.select("fp"), radius))
    return _named(rows, prints.withColumn("number", F.col("fp")), found)


def _named(rows: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``component_id``, from ``prints(fp, least, number)`` and the components of
    their numbers."""
    members = saved(prints.join(found, F.col("number") == F.col("node"), "left")
                    .select("fp", "least", "component"), "members")
    smallest = saved(members.where(F.col("component").isNotNull())
                     .groupBy(F.col("component").alias("__c")).agg(F.min("least").alias("of")),
                     "smallest")
    named = saved(members.join(bounded(smallest), F.col("component") == F.col("__c"), "left")
                  .select("fp", F.when(F.col("component").isNull(), F.col("least"))
                          .otherwise(F.col("of")).alias("component_id")), "named")
    return rows.join(bounded(named), F.col("fingerprint") == F.col("fp")).drop("fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one left of each group: the one with the smallest id. Rows without
    an id stay only where their group has no id at all, and then one of them."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are first in their group, by ``found(id, row_hash, fingerprint,
    component_id)``."""
    found = found.withColumn("__first", F.col(id_col).eqNullSafe(F.col("component_id")))
    # equal ids in one group: the row with the smallest hash
    first = saved(found.where("__first").groupBy("component_id", "fingerprint")
                  .agg(F.min("row_hash").alias("h")), "first")
    first = first.groupBy(F.col("component_id").alias("__k")).agg(
        F.min(F.struct("fingerprint", "h")).alias("__w"))
    decided = found.join(bounded(saved(first, "winners")),
                         F.col("component_id").eqNullSafe(F.col("__k")), "left")
    kept = F.col("__first") & (F.struct("fingerprint", F.col("row_hash").alias("h")) == F.col("__w"))
    decisions = decided.groupBy(id_col, "row_hash").agg(F.max(kept).alias("kept"),
                                                        F.count("*").alias("rows"))
    return keep_rows(docs, decisions, id_col, text_col)


def near_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")
