"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text's UTF-8 bytes are cut into blocks of one size. Blocks are sorted, equal ones lie together, and
each gets an integer as its name: the number of its first occurrence. Then adjacent pairs of names
are named in the same way, until a document has one name left. Names stand for contents and not for
their hashes, so together with the number of blocks they identify a text without collisions.

Contents are shuffled once. A content that very many blocks share is dealt out by a salt, named
within each part, and the parts' names, which are few, are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.llm.common import bounded, keep_rows, row_hash
from codelode.sources.scratch import saved

#: Bytes in a block.
BLOCK_BYTES = 4096
#: Rows of one content that are named in one group; more are dealt out to several.
GROUP_ROWS = 2_000


def _named(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``rows`` with ``name``: the smallest ``occ`` (a number of its own for each row) of the rows
    with equal ``keys``. Keys are dropped, the rows are saved."""
    rows = rows.withColumn("__h", F.xxhash64(*keys))
    hot = (rows.groupBy("__h").agg(F.count("*").alias("__n")).where(F.col("__n") > GROUP_ROWS)
           .withColumnRenamed("__h", "__hot"))
    hot = bounded(saved(hot, "hot"))
    parts = F.ceil(F.col("__n") / GROUP_ROWS)
    salted = (rows.join(hot, F.col("__h") == F.col("__hot"), "left")
              .withColumn("__salt", F.when(F.col("__n").isNull(), F.lit(0)).otherwise(
                  F.pmod(F.xxhash64("occ"), parts)).cast("int")))
    local = F.min("occ").over(Window.partitionBy(*keys, "__salt"))
    first = F.col("__n").isNotNull() & (F.col("occ") == F.col("__local"))
    out = saved(salted.withColumn("__local", local).select(
        *keep, "occ", "__local", F.when(first, F.struct(*keys)).alias("__key")), "names")
    shared = out.where(F.col("__key").isNotNull()).select("__key", F.col("__local").alias("__from"))
    shared = saved(shared.select("__from", F.min("__from").over(Window.partitionBy("__key"))
                                 .alias("__to")), "shared")
    return (out.join(bounded(shared), F.col("__local") == F.col("__from"), "left")
            .select(*keep, "occ", F.coalesce("__to", "__local").alias("name")))


def _blocks(docs: DataFrame, text: Column, payload: list[Column], size: int) -> DataFrame:
    data = F.encode(F.coalesce(text.cast("string"), F.lit("")), "utf-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                      lambda i: F.substring(F.col("__data"), i * size + 1, F.lit(size)))
    return (docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*payload)
                        .alias("payload"), data.alias("__data"), count.alias("n"))
            .select("row", "payload", "n", F.posexplode(cut).alias("pos", "block"))
            .withColumn("payload", F.when(F.col("pos") == 0, F.col("payload")))
            .withColumn("occ", F.monotonically_increasing_id()))


def identities(docs: DataFrame, payload: list[Column], text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``payload`` (a struct of the given columns), ``blocks`` and
    ``name``. Two rows have equal (blocks, name) exactly when their texts are equal."""
    keep = ["row", "pos", "blocks", "n", "payload"]
    level = _blocks(docs, F.col(text_col), payload, block_bytes).withColumn("blocks", F.col("n"))
    level = _named(level, ["block"], keep)
    done = []
    while True:
        level = saved(level, "level")
        done.append(level.where(F.col("n") == 1).select("row", "payload", "blocks", "name"))
        if level.where(F.col("n") > 1).isEmpty():
            break
        half = F.col("pos") % 2 == 0
        pairs = (level.where(F.col("n") > 1)
                 .groupBy("row", F.expr("pos div 2").cast("int").alias("pos"), "blocks",
                          F.ceil(F.col("n") / 2).cast("int").alias("n"))
                 .agg(F.max(F.when(half, F.col("name"))).alias("left"),
                      F.max(F.when(~half, F.col("name"))).alias("right"),
                      F.min("occ").alias("occ"), F.max("payload").alias("payload"))
                 .withColumn("right", F.coalesce("right", F.lit(-1))))
        level = _named(pairs, ["left", "right"], keep)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    and ``row_hash``.

    A null text counts as empty, and empty texts are a group like any other. Of equal texts the row
    with the largest id stays; a null id is below all others. Of rows with that same id one stays
    (the last one read). An empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = saved(identities(docs, [F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                                   row_hash(text).alias("hash")], text_col, block_bytes), "ids")
    groups = rows.groupBy("blocks", "name").agg(
        F.count("*").alias("__size"), F.max(F.struct(F.col("payload.id").alias("id"), "row"))
        .alias("__keep"))
    groups = saved(groups.where(F.col("__size") > 1).withColumnsRenamed(
        {"blocks": "__blocks", "name": "__name"}), "groups")
    joined = rows.join(bounded(groups), (F.col("blocks") == F.col("__blocks"))
                       & (F.col("name") == F.col("__name")), "left")
    kept = F.col("__keep").isNull() | (F.col("__keep.row") == F.col("row"))
    return joined.select(
        F.col("payload.id").alias(id_col),
        F.when(F.col("__keep").isNull(), F.col("payload.id")).otherwise(F.col("__keep.id"))
        .alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"),
        F.lower(F.hex("payload.sha")).alias("text_sha256"), F.col("payload.hash").alias("row_hash"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col)
    decisions = found.groupBy(id_col, "row_hash").agg(
        F.max("kept").alias("kept"), F.count("*").alias("rows"))
    return keep_rows(docs, decisions, id_col, text_col)


def duplicates_report(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).drop("row_hash")
