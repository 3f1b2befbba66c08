"""Evaluation of rankings on commit history: a commit message is a task, the files the
commit touched are the right answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelode.functions.numbers import rounded
from codelode.operators.retrieve import cost, salted
from codelode.functions.paths import basename
from codelode.functions.regex import SPACE_CHARS, rx, squeeze, trim
from codelode.sources.scratch import saved


# Which commits and files count.
MIN_MESSAGE_LENGTH = 15
TRAILER = (
    r"^(co-authored-by|claude-session|signed-off-by|reviewed-by|acked-by|tested-by|reported-by"
    r"|suggested-by|helped-by|cc|change-id|refs?|see-also|fixes|closes):"
)
LOCKFILES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb",
    "cargo.lock", "poetry.lock", "pipfile.lock", "gemfile.lock", "composer.lock", "go.sum",
]
EXCLUDED_EXTENSIONS = [
    ".md", ".markdown", ".rst", ".txt", ".json", ".yml", ".yaml", ".lock", ".toml", ".ini",
    ".cfg",
]
DOC_FOLDER = r"(^|/)docs?/"
# Fixed values end.

TASK_KEY = ["repo", "task_id"]


def read_commit_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Log file (``@@hash|subject|body`` blocks with file names) -> blocks(repo, block).
    The reader itself cuts at block starts, so a long log is read in parallel."""
    text = spark.read.option("lineSep", "\n@@").text(path)
    return text.select(F.lit(repo).alias("repo"),
                       F.regexp_replace("value", "^@@", "").alias("block")).where(
        trim(F.col("block")) != "")


#: Up to the last line that is not a file name, of a text with a line break in front: a blank line, one with
#: white space inside or one that starts a block. The first part is greedy, so lines are tried from the last on.
#: Visible ASCII goes ahead of the class of white space, which takes many times as long for a character.
_SPACE = rx(r"[\s]").replace(r"\n", "")
LAST_NO_PATH = (r"(?s)\A(.*\n(?>(?=[!-~])|" + _SPACE + r"*)(?:(?=\n|\z)|@@|[!-~]*+(?!\n|\z)" + rx(r"\S") + r"*+(?!\n|\z)"
                + _SPACE + r"++[^\n]))")


def parse_commits(blocks: DataFrame) -> DataFrame:
    """blocks(repo, block) -> commits(repo, hash, subject, body, files). The files are the
    trailing lines without white space; the body is what stands before them."""
    head = F.substring_index("block", "\n", 1)
    rest = F.substr("block", F.length(head) + 2)

    def breaks(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    # Arrays with the row in them, exploded, so that a step's results are worked out once (see usable_commits).
    read = F.struct(F.split(head, r"\|", 3).alias("head"), F.split(rest, "\n").alias("lines"),
                    F.rtrim(rest, F.lit(SPACE_CHARS)).alias("text"))
    split = blocks.select("repo", F.explode(F.filter(F.array(read), lambda b: F.size(b["head"]) == 3)).alias("b"))
    # the last line with text, and the last one up to it that is not a file name, both from 1
    text = F.col("b.text")
    stop = breaks(F.regexp_extract(F.concat(F.lit("\n"), text), LAST_NO_PATH, 1))
    ends = F.struct(F.when(text == "", 0).otherwise(breaks(text) + 1).alias("last"),
                    F.when(text == "", 0).otherwise(stop).alias("stop"))
    found = split.select("repo", "b", F.explode(F.array(ends)).alias("at"))
    lines, part = F.col("b.lines"), lambda i: F.get(F.col("b.head"), F.lit(i))
    return found.select(
        "repo", trim(part(0)).alias("hash"), trim(part(1)).alias("subject"),
        F.concat(F.array(part(2)), F.slice(lines, F.lit(1), F.col("at.stop"))).alias("body"),
        F.transform(F.slice(lines, F.col("at.stop") + 1, F.col("at.last") - F.col("at.stop")), trim).alias("files"))


def usable_commits(commits: DataFrame) -> DataFrame:
    """Adds ``task`` (subject and body without trailers); drops merges and short messages."""
    body = F.filter(F.transform("body", trim),
                    lambda l: (l != "") & ~l.rlike("(?i)" + rx(TRAILER)))
    task = squeeze(F.array_join(F.concat(F.array("subject"), body), " "))
    kept = [c for c in commits.columns if c != "repo"]
    # One array with the row in it, filtered and exploded: a plain filter on ``task`` would be
    # pushed below the parsing and repeat all of it.
    row = F.filter(F.array(F.struct(*kept, task.alias("task"))), lambda c: (
        (F.length(c["task"]) >= MIN_MESSAGE_LENGTH)
        & ~c["subject"].rlike("(?i)" + rx(r"^merge\b"))))
    return commits.select("repo", F.explode(row).alias("c")).select(
        "repo", *[F.col(f"c.{c}").alias(c) for c in [*kept, "task"]])


def is_excluded_target(path: Column, out_dir: str = "") -> Column:
    """Documents, lock files, data and configuration, the output directory."""
    lower = F.lower(path)
    base = basename(lower)
    extension = F.regexp_extract(base, r"^.+(\.[^.]*)\z", 1)
    excluded = base.isin(LOCKFILES) | extension.isin(EXCLUDED_EXTENSIONS) | lower.rlike(DOC_FOLDER)
    out = out_dir.replace("\\", "/").removeprefix("./").rstrip("/").lower()
    if out:
        excluded = excluded | (lower == out) | F.startswith(lower, F.lit(out + "/"))
    return excluded


def target_filter(touched: DataFrame, out_dir: str = "") -> DataFrame:
    return touched.where(~is_excluded_target(F.col("path"), out_dir))


def touched_files(commits: DataFrame) -> DataFrame:
    """touched(repo, hash, path), distinct within a commit (row-local)."""
    return commits.select("repo", "hash", F.explode(F.array_distinct("files")).alias("path"))


def touched_in_map(touched: DataFrame, files: DataFrame) -> DataFrame:
    """Touched files that the map has, each once per commit."""
    known = files.select("repo", F.col("file").alias("path"))
    return touched.join(known, ["repo", "path"], "left_semi").dropDuplicates(
        ["repo", "hash", "path"])


def commit_tasks(commits: DataFrame, targets: DataFrame) -> DataFrame:
    """tasks(repo, task_id, text) of the commits that have a target."""
    return commits.join(targets.select("repo", "hash"), ["repo", "hash"], "left_semi").select(
        "repo", F.col("hash").alias("task_id"), F.col("task").alias("text"))


def grouped_targets(touched: DataFrame) -> DataFrame:
    """targets(repo, task_id, files, targets) from touched(repo, hash, path): one row per commit. A commit's
    files come from one row of the log, so they fit in one."""
    return touched.groupBy("repo", F.col("hash").alias("task_id")).agg(
        F.collect_list("path").alias("files"), F.count("*").alias("targets"))


def alike_tasks(tasks: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """alike(repo, task_id, like, alone): ``like`` is the first task with the same text in the repository,
    whose ranking serves for all of them; ``alone``: there is no other. Tasks in ``own``(repo, task_id), as
    those with answers of a model, stand for themselves. A task that comes with several texts needs the same
    ones."""
    texts = tasks.groupBy(*TASK_KEY).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    if own is None:
        texts = texts.withColumn("by", F.lit(None).cast("string"))
    else:
        texts = texts.join(own.select(*TASK_KEY, F.col("task_id").alias("by")).distinct(), TASK_KEY, "left")
    texts = saved(texts.select(*TASK_KEY, F.to_json(F.struct("by", "texts")).alias("same")), "texts")
    groups = texts.groupBy("repo", "same").agg(
        F.min("task_id").alias("like"), (F.count("*") == 1).alias("alone"))
    several = saved(groups.where(~F.col("alone")).drop("alone"), "alike", plain=True)
    dealt, spread = salted(texts, several, ["repo", "same"], ["task_id"])
    found = dealt.join(spread, ["repo", "same", "salt"], "left")
    return found.select(*TASK_KEY, F.coalesce("like", "task_id").alias("like"), F.col("like").isNull().alias("alone"))


def _placed(ranked: DataFrame) -> DataFrame:
    """Proposed files of a task: ``rank`` over all its parts, in part order, then rank; first wins. ``best`` is
    the best rank in any part."""
    first = ranked.groupBy(*TASK_KEY, "file").agg(
        F.min(F.struct("part_no", F.col("rank").alias("r"))).alias("_at"), F.min("rank").alias("best"))
    order = Window.partitionBy(*TASK_KEY).orderBy("_at")
    return first.select(*TASK_KEY, "file", F.row_number().over(order).alias("rank"), "best")


def union_files(ranked: DataFrame) -> DataFrame:
    """Proposed files of a task over all its parts, in part order, then rank; first wins."""
    return _placed(ranked).drop("best")


def first_hit_rank(proposed: DataFrame, targets: DataFrame) -> DataFrame:
    """Rank of the first proposed file that is a target(repo, task_id, file); 0 = none. One
    row per task that has targets."""
    hits = targets.join(proposed, [*TASK_KEY, "file"], "left")
    return hits.groupBy(*TASK_KEY).agg(F.coalesce(F.min("rank"), F.lit(0)).alias("rank"))


def coverage_at_k(ranked: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of the targets found among the first k files of any part, to 3 decimals."""
    best = ranked.groupBy(*TASK_KEY, "file").agg(F.min("rank").alias("rank"))
    joined = targets.join(best, [*TASK_KEY, "file"], "left")
    return joined.groupBy(*TASK_KEY).agg(*[
        _share(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"coverage{k}")
        for k in ks])


def bench_rows(
    ranked: DataFrame, targets: DataFrame, task_parts: DataFrame, mode: str,
    usage: DataFrame | None = None,
) -> DataFrame:
    """One row per task and mode: number of targets and parts, rank of the first hit, coverage,
    and calls, tokens and price from usage(repo, task_id, calls, tokens, cost_usd[, error]). A
    price that is not given follows from the tokens. A task with an error counts as not found
    and as free."""
    n_targets = targets.groupBy(*TASK_KEY).agg(F.count("*").alias("targets"))
    rows = (
        first_hit_rank(union_files(ranked), targets)
        .join(coverage_at_k(ranked, targets), TASK_KEY)
        .join(n_targets, TASK_KEY)
        .join(_count_parts(task_parts), TASK_KEY, "left")
    )
    return _finished(rows if usage is None else rows.join(usage, TASK_KEY, "left"), mode)


#: Most tasks that stand for others whose proposed files are broadcast; a task has few of them.
BROADCAST_ALIKE = 10_000


def bench_rows_alike(
    ranked: DataFrame, targets: DataFrame, task_parts: DataFrame, mode: str, alike: DataFrame,
    spent: DataFrame | None = None, usage: DataFrame | None = None,
) -> DataFrame:
    """:func:`bench_rows` for tasks of which many have one ranking: ``ranked``, ``task_parts`` and
    spent(repo, task_id, calls, tokens, cost_usd) hold only those that ``alike`` (see :func:`alike_tasks`)
    names, and serve for the others. ``targets`` are grouped, ``usage`` is of all tasks and goes before
    ``spent``. Rankings are not copied for each task: a row has the targets of a task beside the files
    proposed for it, and hits and coverage are worked out on that row."""
    files = _placed(ranked.repartition(*TASK_KEY)).groupBy(*TASK_KEY).agg(
        F.collect_list(F.struct("file", "rank", "best")).alias("placed"))
    known = _count_parts(task_parts).join(files, TASK_KEY, "left")
    if usage is None and spent is not None:
        known = known.join(spent, TASK_KEY, "left")
    known = saved(known.withColumnRenamed("task_id", "like"), "placed").hint("merge")
    by_like = targets.join(alike.hint("merge"), TASK_KEY)
    # One by one on one side, those with a common ranking on the other, where a few keys may have most rows.
    alone = by_like.where("alone").join(known, ["repo", "like"], "left")
    first = alike.where("not alone").select("repo", "like").distinct()
    common = saved(known.join(first, ["repo", "like"], "left_semi"), "common", plain=True)
    others = by_like.where("not alone")
    if common.count() <= BROADCAST_ALIKE:
        others = others.join(F.broadcast(common), ["repo", "like"], "left")
    else:
        dealt, spread = salted(others, common, ["repo", "like"], ["task_id"])
        others = dealt.join(spread, ["repo", "like", "salt"], "left").drop("salt")
    hits = F.coalesce(F.filter("placed", lambda f: F.array_contains("files", f["file"])), F.array())
    rows = alone.unionByName(others).withColumn("placed", hits)

    def covered(k: int) -> Column:
        return _share(F.size(F.filter("placed", lambda f: f["best"] <= k)), F.col("targets"))

    rows = rows.withColumns({
        "rank": F.coalesce(F.array_min(F.transform("placed", lambda f: f["rank"])), F.lit(0)),
        "coverage1": covered(1), "coverage3": covered(3)})
    return _finished(rows if usage is None else rows.join(usage, TASK_KEY, "left"), mode)


def _count_parts(task_parts: DataFrame) -> DataFrame:
    return task_parts.groupBy(*TASK_KEY).agg(F.count("*").alias("parts"))


def _share(found: Column, of: Column) -> Column:
    return rounded(found / of, 3)


def _finished(rows: DataFrame, mode: str) -> DataFrame:
    """Prices that are not given, and nothing found for tasks with an error."""
    spent = {"calls": "bigint", "tokens": "bigint", "cost_usd": "double", "error": "string"}
    none = {"error": F.lit(None)} if "calls" in rows.columns else {c: F.lit(0) for c in spent} | {"error": F.lit(None)}
    rows = rows.withColumns({c: v.cast(spent[c]) for c, v in none.items() if c not in rows.columns})
    price = rounded(F.coalesce(F.nullif("cost_usd", F.lit(0.0)), cost(F.col("tokens"))), 6)
    rows = rows.withColumn("cost_usd", price)
    counted = ("parts", "rank", "coverage1", "coverage3", "calls", "tokens", "cost_usd")
    return rows.select(
        *TASK_KEY, F.lit(mode).alias("mode"), "targets",
        *[F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
          .cast(rows.schema[c].dataType).alias(c) for c in counted], "error")


def bench_summary(rows: DataFrame) -> DataFrame:
    """Per mode: share of tasks with a hit in the first 1, 3, 5 files (percent), mean calls
    and tokens, total price, mean coverage of the first 3 (percent)."""
    def top(k: int) -> Column:
        hit = F.count_if((F.col("rank") >= 1) & (F.col("rank") <= k))
        return rounded(F.lit(100) * hit / F.count("*")).cast("int").alias(f"top{k}")

    failed = F.col("error").isNotNull()
    return rows.groupBy("mode").agg(
        F.count("*").alias("commits"), top(1), top(3), top(5),
        rounded(F.avg("calls"), 1).alias("calls"),
        rounded(F.avg("tokens")).cast("bigint").alias("tokens"),
        rounded(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.count_if(failed).alias("errors"),
        rounded(F.lit(100) * F.avg("coverage3")).cast("int").alias("coverage_top3"))


__all__ = [
    "read_commit_log", "parse_commits", "usable_commits", "target_filter",
    "touched_files", "touched_in_map", "commit_tasks", "union_files", "first_hit_rank",
    "coverage_at_k", "grouped_targets", "alike_tasks", "bench_rows", "bench_rows_alike", "bench_summary",
]
