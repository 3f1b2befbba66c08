"""Hit rates of the ranking on commit history: all commits and modes in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codelode.operators import evaluate as E
from codelode.operators.retrieve import token_index
from codelode.plans.find import find
from codelode.sources.scratch import saved


Answers = DataFrame | Callable[[DataFrame], DataFrame] | None


def bench(
    blocks: DataFrame, units: DataFrame, files: DataFrame, *, split: str = "heuristic",
    answers: dict[str, Answers], usage: dict[str, DataFrame] | None = None,
    out_dir: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Log blocks(repo, block) -> (rows, summary). ``answers`` maps each mode to the table
    of model answers for it, or None for keyword order; a function makes the table from
    targets(repo, task_id, files, targets), one row per commit. Calls, tokens and prices are those of
    the parts, unless ``usage`` gives them.

    Messages repeat: of tasks with the same text and no answers one is searched for, see
    ``E.alike_tasks``. The log is parsed once, and of a commit only what later steps read is saved."""
    parsed = E.usable_commits(E.parse_commits(blocks))
    commits = saved(parsed.select("repo", "hash", "files", "task"), "commits").hint("merge")
    touched = E.touched_in_map(E.target_filter(E.touched_files(commits), out_dir), files)
    targets = saved(E.grouped_targets(touched), "targets").hint("merge")
    tasks = saved(E.commit_tasks(commits, targets.withColumnRenamed("task_id", "hash")), "tasks").hint("merge")
    index = saved(token_index(units), "stems")
    rows = []
    for mode, given in answers.items():
        given = saved(given(targets), "answers", plain=True) if callable(given) else given
        alike = saved(E.alike_tasks(tasks, given), "alike").hint("merge")
        asked = tasks.join(alike.where(F.col("like") == F.col("task_id")), E.TASK_KEY, "left_semi")
        found = find(asked, units, mode=mode, split=split, answers=given, index=index)
        parts = saved(found["parts"].select(*E.TASK_KEY, "calls", "tokens", "cost_usd"), "asked")
        rows.append(E.bench_rows_alike(
            found["files"], targets, parts, mode, alike, _spent(parts), (usage or {}).get(mode)))
    all_rows = reduce(DataFrame.unionByName, rows)
    return all_rows, E.bench_summary(all_rows)


def _spent(parts: DataFrame) -> DataFrame:
    """spent(repo, task_id, calls, tokens, cost_usd) from the parts of a search."""
    return parts.groupBy("repo", "task_id").agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"))
