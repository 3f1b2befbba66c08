"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records over memory-sized buckets by a seeded hash of their id and text. Pass two
puts a bucket's records into one array, in a fixed order, and shuffles it; Spark's ``shuffle`` is the
Fisher-Yates shuffle with a seed. Bucket ``i`` is partition ``i`` and has one array, so a task that
runs again after a loss shuffles alike. The buckets in order are a random permutation of all
records, which is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.llm.common import bounded
from codelode.sources.scratch import saved

#: Bytes of records in a bucket. A task holds a few copies of its bucket.
BUCKET_BYTES = 16 << 20
N_SHARDS = 40


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, and 16 for the rest of the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 42,
          bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot`` (place in the shard, from 0).

    Rows are scattered by id and text, so one id (or null) may have any number of texts; a null
    text counts as empty. Rows that are equal in both are all kept, in one bucket. Fewer rows than
    shards leave shards empty, an empty table gives no rows. Columns of ``docs`` named ``shard`` or
    ``slot`` are replaced. Columns must be of types that can be sorted (no maps).
    """
    docs = docs.drop("shard", "slot")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.sum(record_bytes(F.col(text_col)))).first()[0] or 0
    n_buckets = max(1, math.ceil(size / bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col), text)
    bucket = F.pmod(key, F.lit(n_buckets)).cast("int")
    counts = saved(docs.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n")), "buckets")
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0))
                                  .alias("__offset")), "offsets")
    total = counts.agg(F.sum("__n")).first()[0] or 0

    scattered = docs.select(bucket.alias("__bucket"), F.struct(
        F.col(id_col).alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        .alias("row")).alias("__record")).repartitionById(n_buckets, F.col("__bucket"))
    shuffled = (scattered.groupBy("__bucket")
                .agg(F.sort_array(F.collect_list("__record")).alias("__records"))
                .select("__bucket", F.posexplode(F.shuffle("__records", seed))
                        .alias("__at", "__record")))
    place = F.col("__offset") + F.col("__at")
    number = F.expr(f"cast((__place * {n_shards}) div {max(1, total)} as int)")
    first = F.expr(f"(shard * {max(1, total)}L + {n_shards - 1}) div {n_shards}")
    return (shuffled.join(bounded(offsets), "__bucket").withColumn("__place", place)
            .select("__record.row.*", "__place").withColumn("shard", number)
            .withColumn("slot", F.col("__place") - first).drop("__place"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard. Rows are in the order of their slots in each file, and the
    files' names in the order of the slots, so nothing is moved again."""
    sharded.write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """Where each document goes, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(docs.select("doc_id", "text"), **options).select(
        "doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
