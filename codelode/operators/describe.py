"""Descriptions of units: merging known ones, and packing requests for missing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.functions.numbers import rounded
from codelode.functions.regex import squeeze, trim
from codelode.operators.extract import unit_source
from codelode.sources.scratch import saved

# Request sizes and prices.
UNITS_PER_REQUEST = 25
HEADER_LINES = 5
DESCRIPTION_MAX = 160
INPUT_USD_PER_MTOKEN = 1
OUTPUT_USD_PER_MTOKEN = 5
CHARS_PER_TOKEN = 4
# Fixed values end.


def _one_per_key(rows: DataFrame) -> DataFrame:
    """(repo, key, text): one row per key. Tables have no order, so of several texts the smallest
    one stays, blank ones behind all others; empty texts count as NULL."""
    ranked = F.struct((trim(F.col("text")) == "").alias("blank"), "text")
    return rows.groupBy("repo", "key").agg(
        F.min(F.when(F.col("text") != "", ranked))["text"].alias("text"))


def merge_descriptions(units: DataFrame, descriptions: DataFrame) -> DataFrame:
    """descriptions(repo, key, text) by unit id, else by ``file::name``; blank texts leave
    the description as it is. Of several rows for a key the one with the smallest text counts
    (empty ones come last), so units stay one row each."""
    given = saved(_one_per_key(descriptions), "descriptions", plain=True).select(
        "repo", "key", F.col("text").alias("_text"))
    by_id = given.select("repo", F.col("key").alias("id"), F.col("_text").alias("_by_id"))
    by_name = given.select("repo", F.col("key").alias("_name_key"), F.col("_text").alias("_by_name"))
    named = units.withColumn("_name_key", F.concat("file", F.lit("::"), "name"))
    joined = named.join(by_id, ["repo", "id"], "left").join(by_name, ["repo", "_name_key"], "left")
    chosen = F.nullif(trim(F.coalesce("_by_id", "_by_name")), F.lit(""))
    merged = F.coalesce(chosen, F.nullif("description", F.lit("")), "comment", F.lit(""))
    return joined.select(*[
        merged.alias(c) if c == "description" else F.col(c) for c in units.columns])


def missing_descriptions(
    units: DataFrame, done: DataFrame, cap: int | None = None
) -> DataFrame:
    """Units with a blank description and no entry in done(repo, id); with ``cap`` only the
    first so many of each repository, in map order. ``done`` is saved as it is, since keys made of the
    rows of a small file may be too many to broadcast."""
    blank = units.where(trim(F.coalesce("description", F.lit(""))) == "")
    known = saved(done.select("repo", "id"), "done", plain=True)
    missing = blank.join(known, ["repo", "id"], "left_anti")
    if cap is None:
        return missing.select(*units.columns)
    order = Window.partitionBy("repo").orderBy("file", "start")
    return (missing.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
            .select(*units.columns))


def request_block(text: Column) -> Column:
    """Part of a request that shows one unit: id, kind, lines and source."""
    start, end = F.col("start"), F.col("end")
    n = F.size(F.split(text, "\n", -1))
    first = F.greatest(F.lit(1), start)
    last = F.least(n, F.greatest(first, end), first + 59)
    return F.concat(
        F.lit("### id: "), F.col("id"), F.lit("\n("), F.col("type"), F.lit(" "), F.col("name"),
        F.lit(", lines "), first.cast("string"), F.lit("-"), last.cast("string"),
        F.lit(")\n```\n"), unit_source(text, start, end), F.lit("\n```"))


def description_batches(
    missing: DataFrame, files: DataFrame, per_request: int = UNITS_PER_REQUEST
) -> DataFrame:
    """Requests (repo, file, batch_no, ids, prompt): the units of one file, at most
    ``per_request`` each. A group is part of one file, so it is bounded by the file size. Texts are
    joined by sorting: the planner may take them for small, and the driver would hold all of them."""
    order = Window.partitionBy("repo", "file").orderBy("start")
    texts = files.select("repo", F.col("path").alias("file"), "text")
    shown = missing.withColumn(
        "batch_no", F.floor((F.row_number().over(order) - 1) / per_request).cast("int")
    ).join(texts.hint("merge"), ["repo", "file"])
    top = F.array_join(F.slice(F.split("text", "\n", -1), 1, HEADER_LINES), "\n")
    rows = shown.select("repo", "file", "batch_no", "start", "id", top.alias("top"),
                        request_block(F.col("text")).alias("block"))
    grouped = rows.groupBy("repo", "file", "batch_no").agg(
        F.first("top").alias("top"),
        F.array_sort(F.collect_list(F.struct("start", "id", "block"))).alias("u"))
    prompt = F.concat(
        F.lit("File: "), F.col("file"), F.lit("\nFirst lines of the file:\n```\n"), F.col("top"),
        F.lit("\n```\n\nUnits:\n\n"), F.array_join(F.col("u.block"), "\n\n"))
    return grouped.select("repo", "file", "batch_no", F.col("u.id").alias("ids"),
                          prompt.alias("prompt"))


def merge_new_descriptions(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new (repo, key, text) to one row per key: new texts are squeezed and cut; a key
    that has a text is never overwritten. Of several texts for a key the smallest one stays."""
    old = _one_per_key(old).withColumn("text", F.coalesce("text", F.lit("")))
    kept = old.where(F.coalesce("text", F.lit("")) != "")
    cleaned = new.select(
        "repo", "key", F.substring(squeeze(F.col("text")), 1, DESCRIPTION_MAX).alias("text")
    ).where(F.col("text") != "")
    added = _one_per_key(cleaned).join(kept.select("repo", "key"), ["repo", "key"], "left_anti")
    rest = old.join(added.select("repo", "key"), ["repo", "key"], "left_anti")
    return rest.select("repo", "key", "text").unionByName(added)


def estimated_tokens(prompt: Column) -> Column:
    return rounded(F.length(prompt) / CHARS_PER_TOKEN).cast("bigint")


def description_cost(usage: DataFrame) -> DataFrame:
    """usage(repo, input_tokens, output_tokens), one row per request -> totals."""
    price = (F.sum("input_tokens") / F.lit(1e6) * INPUT_USD_PER_MTOKEN
             + F.sum("output_tokens") / F.lit(1e6) * OUTPUT_USD_PER_MTOKEN)
    return usage.groupBy("repo").agg(
        F.count("*").alias("requests"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("tokens"),
        rounded(price, 6).alias("cost_usd"))
