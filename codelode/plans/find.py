"""From tasks to ranked units and files, in either mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codelode.functions.numbers import rounded
from codelode.operators import retrieve as R
from codelode.sources.scratch import saved


def find(
    tasks: DataFrame, units: DataFrame, *, mode: str = "scan", split: str = "heuristic",
    most_parts: int | None = None, top: int = R.TOP_UNITS, candidates: int = R.CANDIDATES,
    batch: int = R.SCAN_BATCH, answers: DataFrame | None = None, usage: DataFrame | None = None,
    index: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """tasks(repo, task_id, text) -> {parts, units, files}. ``index`` is a stored one of the units.

    ``answers`` come from a model: for a scan (PART_KEY, file, start, p), for a prefilter
    (PART_KEY, k, p) with k = u1..uN, none, confidence. Parts without answers are ranked by
    keywords alone (p is NULL); parts without a keyword in common have no rows.

    ``parts`` says for each part how it was ranked: ``note`` (NULL: by answers), ``calls``,
    ``tokens`` (from ``usage(PART_KEY, tokens)``), ``cost_usd``, and for a prefilter the
    ``confidence`` of the answer and the probability that ``none`` fits.
    """
    if mode not in ("scan", "prefilter"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = saved(R.parts(tasks, split, most_parts), "parts", plain=True)
    index = saved(R.token_index(units), "stems") if index is None else index
    wide = max(top, candidates)
    early = index.count() >= R.EARLY_ROWS
    nothing = F.lit(None).cast("double")
    if answers is None:
        none_given = parts.select(*R.PART_KEY).where(F.lit(False))
        ranked = R.prefilter(parts, index, wide, early=early).withColumn("p", nothing)
        files = R.rank_files(ranked, by="score").withColumn("p", nothing)
        best = ranked.where(F.col("rank") <= top)
        return {"parts": _reported(parts, none_given, None, mode, units, batch, usage, None),
                "units": R.shape_units(best, units), "files": files}

    answered = parts.join(answers.select(*R.PART_KEY).distinct(), R.PART_KEY, "left_semi")
    empty = R.parts_without_candidates(parts, index) if mode == "prefilter" else None
    fallback = saved(R.keyword_fallback(parts, answered, index, top, candidates, early=early).drop("note"),
                     "fallback", plain=True)
    if mode == "prefilter":
        cands = R.prefilter(answered, index, candidates, early=early)
        scored = saved(R.rerank_choice(cands, answers).drop("keyword_rank"), "scored", plain=True)
        ranked, files = scored.where(F.col("rank") <= top), _files_by_rank(scored)
    else:
        ranked, files = R.ranked_scan(answered, units, answers, top)
        ranked = ranked.withColumn("score", nothing)
    columns = [*R.PART_KEY, "file", "start", "score", "rank", "p"]
    best = ranked.withColumn("p", rounded(F.col("p"), 3)).select(*columns).unionByName(
        fallback.where(F.col("rank") <= top).select(*columns))
    all_files = files.withColumn("score", nothing).unionByName(
        R.rank_files(fallback, by="score").withColumn("p", nothing))
    given = R.choice_summary(answers) if mode == "prefilter" else None
    return {"parts": _reported(parts, answered, empty, mode, units, batch, usage, given),
            "units": R.shape_units(best, units), "files": all_files}


def _reported(
    parts: DataFrame, answered: DataFrame, empty: DataFrame | None, mode: str, units: DataFrame,
    batch: int, usage: DataFrame | None, given: DataFrame | None,
) -> DataFrame:
    """Parts with how they were ranked and what it took."""
    asked = answered.select(*R.PART_KEY)
    if empty is not None:
        asked = asked.join(empty.select(*R.PART_KEY), R.PART_KEY, "left_anti")
    if mode == "prefilter":
        calls = asked.withColumn("calls", F.lit(1).cast("bigint"))
    else:
        calls = R.scan_calls(asked, units, batch)
    out = parts.join(calls, R.PART_KEY, "left")
    note = F.when(F.col("calls").isNull(), F.lit(R.NOTE_NO_ANSWERS))
    if empty is not None:
        lost = empty.select(*R.PART_KEY, F.lit(True).alias("_empty"))
        out = out.join(lost, R.PART_KEY, "left")
        note = F.when(F.col("_empty"), F.lit(R.NOTE_NO_CANDIDATE)).otherwise(note)
    out = out.withColumn("note", note)
    spent = F.lit(0).cast("bigint")
    if usage is not None:
        out = out.join(usage.select(*R.PART_KEY, F.col("tokens").alias("_tokens")), R.PART_KEY, "left")
        spent = F.when(F.col("calls").isNotNull(), F.coalesce("_tokens", spent)).otherwise(spent)
    if given is not None:
        out = out.join(given, R.PART_KEY, "left")
    said = {c: (F.when(F.col("calls").isNotNull(), F.col(c)) if given is not None
                else F.lit(None).cast("double")).alias(c) for c in ("confidence", "none")}
    return out.withColumn("tokens", spent).select(
        *R.PART_KEY, "part", F.lit(mode).alias("mode"), "note",
        F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"), "tokens",
        R.cost(F.col("tokens")).alias("cost_usd"), *said.values())


def _files_by_rank(scored: DataFrame, limit: int = R.TOP_FILES) -> DataFrame:
    """Distinct files of a reranked part, by their best unit."""
    best = scored.groupBy(*R.PART_KEY, "file").agg(
        F.min("rank").alias("_r"), rounded(F.max("p"), 3).alias("p"))
    order = Window.partitionBy(*R.PART_KEY).orderBy("_r")
    return best.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= limit).select(*R.PART_KEY, "rank", "file", "p")
