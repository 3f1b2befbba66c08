"""Ranking units and files for many tasks at once.

The keyword index is an inverted index with one row per (unit, stem). Scoring joins
it with the stems of the task parts; the score of a unit for a part is a sum over
matching stems.

Layout. The side that grows is the index. All stems of a unit lie in one partition, whether
the index is built from units or read from a table bucketed by unit. When the stems of the
task parts are few enough to broadcast (checked, not assumed), the join filters the index
where it lies and sums per (part, unit) there; no row of the index is moved. What moves are
those sums, and not even they when the index is a table bucketed by unit. The last step keeps
the best n units per part inside each partition before the ranks are shuffled (window group
limit). Searches over a large index build few of the pairs (``early_stop``).

When the task side is too large to broadcast, both sides are joined on
(repo, stem, salt): a stem that very many units share gets as many salts as its rows ask for,
so it is spread over tasks, and no other stem is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.functions import text as T
from codelode.functions.hof import bind, join_present
from codelode.functions.numbers import rounded
from codelode.operators import early_stop
from codelode.operators.early_stop import PART_KEY, UNIT_KEY
from codelode.sources.scratch import saved

# Sizes and wording of the ranking requests and results.
TOP_UNITS = 15
TOP_FILES = 10
CANDIDATES = 40
SCAN_BATCH = 60
PRICE_PER_MTOKEN_USD = 0.042
NONE_CRITERION = "None of these units is the right place for the task"
NOTE_NO_ANSWERS = "keyword order only"
NOTE_NO_CANDIDATE = "No unit shares a keyword with the task"
SCAN_QUESTION = (
    "To carry out the task in `task`{project}, a developer must read or modify this code unit: "
)
CHOICE_QUESTION = (
    "A developer must carry out the task described in `task`{project}. Which code unit is the "
    "main place to work on? Consider file, name, what it does, tables and API calls. If the task "
    "touches both backend and frontend, pick the unit that holds the logic to change."
)
# Fixed values end.

# Task text up to this many characters is broadcast; above it the salted join is used.
BROADCAST_TASK_CHARS = 16 * 1024 * 1024
#: Rows of one join key that go to one task; a key with more is dealt out by a salt.
ROWS_PER_SALT = 1_000_000
#: Rows of an index from which searches stop early. Below, summing all pairs takes less time.
EARLY_ROWS = 50_000_000


def parts(tasks: DataFrame, split: str = "heuristic", most: int | None = None) -> DataFrame:
    """tasks(repo, task_id, text) -> parts(repo, task_id, part_no, part), part_no from 1; at
    most ``most`` parts of a task, if that is given."""
    return tasks.select(
        "repo", "task_id", F.posexplode(T.task_parts(F.col("text"), split, most)).alias("pos", "part")
    ).select("repo", "task_id", (F.col("pos") + 1).alias("part_no"), "part")


def part_stems(task_parts: DataFrame) -> DataFrame:
    """Distinct stems of every part: (repo, task_id, part_no, stem)."""
    return task_parts.select(*PART_KEY, F.explode(T.stems(F.col("part"))).alias("stem"))


def token_index(units: DataFrame) -> DataFrame:
    """Inverted index (repo, file, start, stem, weight): weight 1.5 when the stem is in
    the name text of the unit, else 1. Row-local, so building it never shuffles.

    The words of the name text are among those of the search text, so every word of a
    unit is stemmed once. The array is exploded as an expression: exploding a column would
    make the optimizer add a filter on its size, which works the whole array out twice.
    """
    def weighted(names: Column, words: Column, found: Column) -> Column:
        named = F.filter(found, lambda s, i: F.array_contains(names, F.get(words, i)))
        return bind(named, lambda n: F.transform(F.array_distinct(found), lambda s: F.struct(
            s.alias("stem"),
            F.when(F.array_contains(n, s), 1.5).otherwise(1.0).alias("weight"))))

    names = F.array_distinct(T.tokenize(T.unit_name_text()))
    words = F.array_distinct(T.tokenize(T.unit_search_text()))
    stems = bind(names, lambda n: bind(words, lambda w: bind(
        T.stem_words(w), lambda found: weighted(n, w, found))))
    return units.select(*UNIT_KEY, F.explode(stems).alias("s")).select(
        *UNIT_KEY, "s.stem", "s.weight")


def write_token_index(units: DataFrame, table: str, buckets: int) -> None:
    """Save the index bucketed by unit, so that every later ranking reads it in the
    layout in which :func:`keyword_scores` moves nothing before the ranks."""
    (token_index(units).write.mode("overwrite")
     .bucketBy(buckets, *UNIT_KEY).sortBy(*UNIT_KEY).saveAsTable(table))


def _fits_broadcast(task_parts: DataFrame, limit: int) -> bool:
    """Is the whole task text at most ``limit`` characters? Stems are never longer
    than the text they come from, so this bounds what would be broadcast."""
    total = task_parts.agg(F.sum(F.length("part")).alias("n")).first()["n"]
    return (total or 0) <= limit


def salted(
    large: DataFrame, other: DataFrame, keys: list[str], spread_by: list[str],
    rows: int = ROWS_PER_SALT, salts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` and ``salt``. A key with more than ``rows`` rows in
    ``large`` gets a salt for each ``rows`` of them: its rows in ``large`` are dealt out by a
    hash of ``spread_by``, its rows in ``other`` are repeated per salt. Other keys have one
    salt. Rows are counted before anything is moved, and only the counts of large keys are
    kept. ``salts`` gives every key that many instead."""
    if salts is None:
        counts = large.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows)
        hot = saved(counts.select(*keys, F.ceil(F.col("_rows") / rows).alias("_salts")), "salts")
        large, other = large.join(hot, keys, "left"), other.join(hot, keys, "left")
        n = F.coalesce("_salts", F.lit(1)).cast("bigint")
    else:
        n = F.lit(salts).cast("bigint")
    dealt = large.withColumn("salt", F.pmod(F.xxhash64(*spread_by), n))
    repeated = other.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return dealt.drop("_salts"), repeated.drop("_salts")


def keyword_scores(
    task_parts: DataFrame, index: DataFrame, *,
    broadcast_chars: int = BROADCAST_TASK_CHARS, salts: int | None = None,
) -> DataFrame:
    """Score of every (part, unit) with at least one stem in common."""
    wanted = part_stems(task_parts)
    keys = [*PART_KEY, "file", "start"]
    if _fits_broadcast(task_parts, broadcast_chars):
        hits = index.join(F.broadcast(wanted), ["repo", "stem"])
    else:
        dealt, spread = salted(index, wanted, ["repo", "stem"], ["file", "start"], salts=salts)
        hits = dealt.join(spread, ["repo", "stem", "salt"])
    return hits.groupBy(*keys).agg(F.sum("weight").alias("score"))


def _best(df: DataFrame, by: Column, n: int, rank: str) -> DataFrame:
    """First n rows of each part; ties fall to map order (file, then line)."""
    order = Window.partitionBy(*PART_KEY).orderBy(by.desc(), "file", "start")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def prefilter(
    task_parts: DataFrame, index: DataFrame, n: int = CANDIDATES, *,
    broadcast_chars: int = BROADCAST_TASK_CHARS, salts: int | None = None, early: bool = False,
) -> DataFrame:
    """Best n units per part by keyword score: adds ``score`` and ``rank``.

    ``early``: pairs that cannot be among the best n are not built (see ``early_stop``), if the task
    side can be broadcast. ``index`` is then read twice and must be stored. It takes more jobs, and pays
    for large indexes; results are the same."""
    firsts = task_parts.groupBy("repo", "part").agg(F.min(F.struct("task_id", "part_no")).alias("_f")).select(
        "repo", "_f.task_id", "_f.part_no", "part")
    # messages and requests repeat: equal parts of a repository are scored once
    repeats = task_parts.count() > firsts.count()
    scored_parts = saved(firsts, "parts", plain=True) if repeats else task_parts
    if early and _fits_broadcast(scored_parts, broadcast_chars):
        scored, _ = early_stop.candidates(part_stems(scored_parts), index, n)
    else:
        scored = keyword_scores(scored_parts, index, broadcast_chars=broadcast_chars, salts=salts)
    best = _best(scored, F.col("score"), n, "rank")
    if not repeats:
        return best
    named = scored_parts.withColumnsRenamed({"task_id": "_task", "part_no": "_part"})
    best = best.withColumnsRenamed({"task_id": "_task", "part_no": "_part"})
    return (task_parts.join(named, ["repo", "part"]).join(best, ["repo", "_task", "_part"])
            .select(*PART_KEY, "file", "start", "score", "rank"))


def unit_label() -> Column:
    """One-line description of a unit for a yes/no question."""
    def some(field: str, title: str) -> Column:
        return F.when(
            F.size(F.col(field)) > 0,
            F.concat(F.lit(title), F.array_join(F.slice(F.col(field), 1, 5), ", ")),
        )

    kind = F.rtrim(F.concat_ws(" ", F.coalesce(F.when(F.col("type") != "", F.col("type")),
                                               F.lit("unit")),
                               F.coalesce(F.col("name"), F.lit(""))))
    does = T.cut(T.description_of(), 200)
    return join_present(" | ", [
        F.col("file"), kind,
        F.when(does != "", F.concat(F.lit("does: "), does)),
        some("extra.tables", "tables: "), some("extra.calls", "calls: "),
        F.when(F.col("extra.route") != "", F.concat(F.lit("page "), F.col("extra.route"))),
    ])


def _project_clause(project: str) -> str:
    project = project.strip()
    return f" in the project ({project})" if project else ""


def number_in_order(df: DataFrame, group: str, order: list[str], alias: str) -> DataFrame:
    """Consecutive numbers (bigint) from 1 inside each ``group``, in the given order.

    Rows are put into key ranges, as many as their size asks for, and saved. They are numbered
    inside each range and shifted by the number of rows in the ranges before it, so no task
    sorts a whole group. The counts are one row per range and group.
    """
    ranged = saved(df.repartitionByRange(group, *order)
                   .withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(group, "_range").count().select(
        group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(shifts, [group, "_range"])
        .withColumn(alias, (F.col("_inside") + F.col("_shift")).cast("bigint"))
        .drop("_range", "_inside", "_shift")
    )


def scan_questions(
    units: DataFrame, batch: int = SCAN_BATCH, project: str = ""
) -> DataFrame:
    """One yes/no question per unit, in batches of ``batch`` in map order.

    The text of a question does not depend on the task (the task is sent beside it), so
    the questions of a repository are written once and serve every task.
    """
    head = SCAN_QUESTION.format(project=_project_clause(project))
    numbered = number_in_order(units, "repo", ["file", "start"], "_n")
    position = F.col("_n") - 1
    return numbered.select(
        *UNIT_KEY, "id",
        F.expr(f"(_n - 1) div {batch}").alias("batch_no"),
        F.concat(F.lit("q"), (position % batch).cast("string")).alias("q"),
        F.concat(F.lit(head), unit_label()).alias("instructions"),
    )


def scan_batches(questions: DataFrame) -> DataFrame:
    """One row per request body: the questions of a batch, in order. A batch holds at
    most ``batch`` rows, so no group grows with the data."""
    ordered = F.array_sort(F.collect_list(F.struct(
        F.substring("q", 2, 9).cast("int").alias("k"), "q", "instructions")))
    return questions.groupBy("repo", "batch_no").agg(ordered.alias("_q")).select(
        "repo", "batch_no",
        F.map_from_entries(F.transform("_q", lambda s: F.struct(s.q, s.instructions))).alias(
            "questions"),
    )


def scan_calls(task_parts: DataFrame, units: DataFrame, batch: int = SCAN_BATCH) -> DataFrame:
    """Number of requests a full scan sends per part."""
    sizes = units.groupBy("repo").agg(F.ceil(F.count("*") / batch).alias("calls"))
    return task_parts.join(sizes, "repo", "left").select(
        *PART_KEY, F.coalesce("calls", F.lit(0)).alias("calls"))


def apply_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Probability of each (part, unit) that was answered; questions(PART_KEY, file,
    start, ...) without an answer get 0."""
    return questions.join(
        answers.select(*PART_KEY, "file", "start", F.col("p").alias("_p")),
        [*PART_KEY, "file", "start"], "left",
    ).withColumn("p", F.coalesce("_p", F.lit(0.0))).drop("_p")


def scan_scores(
    task_parts: DataFrame, units: DataFrame, answers: DataFrame,
    top: int = TOP_UNITS, top_files: int = TOP_FILES,
) -> DataFrame:
    """Everything of a full scan that can reach the result: (part, unit, p).

    A scan gives every unit a probability, 0 when unanswered. Only the units with
    p > 0 can come before the rest, and the rest stands in map order; so per part it is
    enough to keep the positive answers plus, with p = 0, the first ``top`` units and the
    first unit of each of the first ``top_files`` files of the repository. Results are the
    same as those of the full product of parts and units, which is never built; they are
    complete for at most ``top`` units and ``top_files`` files (see :func:`ranked_scan`).
    """
    keys = [*PART_KEY, "file", "start"]
    positive = _positive(task_parts, units, answers)
    known = units.select(*UNIT_KEY)
    in_order = Window.partitionBy("repo").orderBy("file", "start")
    head_units = (known.withColumn("_n", F.row_number().over(in_order))
                  .where(F.col("_n") <= top).select(*UNIT_KEY))
    head = head_units.union(_first_files(units, top_files).select(*UNIT_KEY)).distinct()
    rest = (
        task_parts.select(*PART_KEY).join(head, "repo")
        .join(positive.select(*keys), keys, "left_anti")
        .withColumn("p", F.lit(0.0))
    )
    return positive.unionByName(rest.select(*keys, "p"))


def _positive(task_parts: DataFrame, units: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers above 0 for known parts and units."""
    return (
        answers.where(F.col("p") > 0).select(*PART_KEY, "file", "start", F.col("p").cast("double").alias("p"))
        .join(task_parts.select(*PART_KEY), PART_KEY, "left_semi")
        .join(units.select(*UNIT_KEY), UNIT_KEY, "left_semi")
    )


def _first_files(units: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files of every repository in map order, with their first unit."""
    files = units.groupBy("repo", "file").agg(F.min("start").alias("start"))
    return files.withColumn("_n", F.row_number().over(
        Window.partitionBy("repo").orderBy("file"))).where(F.col("_n") <= n)


def scan_files(task_parts: DataFrame, units: DataFrame, answers: DataFrame, limit: int = TOP_FILES) -> DataFrame:
    """Best files per part of a full scan: :func:`rank_files` of :func:`scan_scores`. The files with a positive
    answer are ranked; those after them are the first ones of the repository, for every part, so they are
    added on the part's row and are neither moved nor sorted."""
    best = rank_files(_positive(task_parts, units, answers), limit)
    found = best.groupBy(*PART_KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "file", "p"))).alias("_found"))
    heads = _first_files(units, limit).groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "file"))), lambda h: h["file"]).alias("_heads"))
    rows = (task_parts.select(*PART_KEY).distinct().join(found, PART_KEY, "left")
            .join(saved(heads, "heads", plain=True), "repo", "left"))
    known = F.coalesce("_found", F.array().cast("array<struct<rank: int, file: string, p: double>>"))
    rest = F.filter(F.coalesce("_heads", F.array().cast("array<string>")),
                    lambda h: ~F.array_contains(F.transform(known, lambda f: f["file"]), h))
    zeros = F.transform(rest, lambda h, i: F.struct(
        (F.size(known) + i + 1).alias("rank"), h.alias("file"), F.lit(0.0).alias("p")))
    return rows.select(*PART_KEY, F.explode(F.slice(F.concat(known, zeros), 1, limit)).alias("f")).select(
        *PART_KEY, "f.rank", "f.file", "f.p")


def ranked_scan(
    task_parts: DataFrame, units: DataFrame, answers: DataFrame,
    top: int = TOP_UNITS, top_files: int = TOP_FILES,
) -> tuple[DataFrame, DataFrame]:
    """Best units and best files per part of a full scan."""
    scored = scan_scores(task_parts, units, answers, top, top_files)
    return rank_units(scored, top), scan_files(task_parts, units, answers, top_files)


def rank_units(scored: DataFrame, top: int = TOP_UNITS, by: str = "p") -> DataFrame:
    """Best ``top`` units per part, with p to three decimals."""
    ranked = _best(scored, F.col(by), top, "rank")
    return ranked.withColumn("p", rounded(F.col("p"), 3)) if "p" in scored.columns else ranked


def rank_files(scored: DataFrame, limit: int = TOP_FILES, by: str = "p") -> DataFrame:
    """Distinct files per part, ordered by their best unit; at most ``limit``."""
    digits = rounded(F.col("best"), 3) if by == "p" else F.col("best")
    best = scored.groupBy(*PART_KEY, "file").agg(
        F.max(by).alias("best"), F.max_by(F.col("start"), F.struct(
            F.col(by), (-F.col("start")).alias("earlier"))).alias("start"))
    return _best(best, F.col("best"), limit, "rank").select(
        *PART_KEY, "rank", "file", digits.alias(by))


def shape_units(ranked: DataFrame, units: DataFrame) -> DataFrame:
    """Result rows: id, line, name and the description cut at 120 characters."""
    shown = units.select(
        *UNIT_KEY, "id", "name", T.cut(T.description_of(), 120).alias("description"))
    return ranked.join(shown, UNIT_KEY).withColumnRenamed("start", "line")


def choice_criteria(candidates: DataFrame, units: DataFrame, project: str = "") -> DataFrame:
    """One choice question per part over its candidates u1..uN, plus ``none``."""
    def some(field: str) -> Column:
        return F.when(F.size(F.col(field)) > 0, F.slice(F.col(field), 1, 6)).alias(
            field.split(".")[1])

    entry = F.to_json(F.struct(
        "file", F.col("name").alias("unit"), "type",
        T.cut(T.description_of(), 220).alias("does"),
        some("extra.tables"), some("extra.calls"),
        F.when(F.col("extra.route") != "", F.col("extra.route")).alias("route"),
    ))
    described = candidates.join(units, UNIT_KEY).select(*PART_KEY, "rank", entry.alias("entry"))
    # At most CANDIDATES rows per part.
    listed = described.groupBy(*PART_KEY).agg(
        F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("c"))
    none = F.struct(F.lit("none").alias("k"), F.lit(NONE_CRITERION).alias("v"))
    entries = F.transform("c", lambda c: F.struct(
        F.concat(F.lit("u"), c["rank"].cast("string")).alias("k"), c["entry"].alias("v")))
    return listed.select(
        *PART_KEY,
        F.lit(CHOICE_QUESTION.format(project=_project_clause(project))).alias("instructions"),
        F.map_from_entries(F.concat(entries, F.array(none))).alias("criteria"),
    )


def rerank_choice(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Order candidates by answered probability: answers(PART_KEY, k, p) with k = u1..uN.
    The keyword score stays; ``rank`` becomes the new rank; ties keep keyword order."""
    keyed = candidates.withColumn("k", F.concat(F.lit("u"), F.col("rank").cast("string")))
    given = answers.select(*PART_KEY, "k", F.col("p").cast("double").alias("p"))
    joined = keyed.join(given, [*PART_KEY, "k"], "left").withColumn(
        "p", F.coalesce("p", F.lit(0.0)))
    order = Window.partitionBy(*PART_KEY).orderBy(F.col("p").desc(), "keyword_rank")
    return joined.withColumnRenamed("rank", "keyword_rank").withColumn(
        "rank", F.row_number().over(order)).drop("k")


def choice_summary(answers: DataFrame) -> DataFrame:
    """Confidence and probability of ``none`` per part (answers with k = none and
    k = confidence), none to three decimals."""
    def value(k: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("k") == k, F.col("p"))), F.lit(0.0))

    return answers.groupBy(*PART_KEY).agg(
        value("confidence").alias("confidence"), rounded(value("none"), 3).alias("none"))


def keyword_fallback(
    task_parts: DataFrame, answered: DataFrame, index: DataFrame,
    top: int = TOP_UNITS, n: int = CANDIDATES, **options,
) -> DataFrame:
    """Keyword order, without p, for the parts that have no answers."""
    open_parts = task_parts.join(answered.select(*PART_KEY), PART_KEY, "left_anti")
    return prefilter(open_parts, index, max(top, n), **options).withColumn(
        "p", F.lit(None).cast("double")).withColumn("note", F.lit(NOTE_NO_ANSWERS))


def no_candidate_parts(task_parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parts that share no keyword with any unit."""
    return task_parts.join(candidates.select(*PART_KEY), PART_KEY, "left_anti").withColumn(
        "note", F.lit(NOTE_NO_CANDIDATE))


def parts_without_candidates(task_parts: DataFrame, index: DataFrame) -> DataFrame:
    """The same from the index, without scores: the wanted stems are looked up in it, and a part
    that has none of those found shares no keyword with any unit."""
    wanted = part_stems(task_parts)
    stems = wanted.select("repo", "stem").distinct()
    found = index.select("repo", "stem").join(stems, ["repo", "stem"], "left_semi").distinct()
    return no_candidate_parts(task_parts, wanted.join(found, ["repo", "stem"], "left_semi"))


def cost(tokens: Column) -> Column:
    """Price in USD of a number of input tokens."""
    return rounded(tokens / F.lit(1e6) * F.lit(PRICE_PER_MTOKEN_USD), 6)


def task_cost(usage: DataFrame) -> DataFrame:
    """usage(PART_KEY, tokens) -> calls, tokens and price per task; each part's price is
    rounded before it is added."""
    return usage.groupBy("repo", "task_id").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"),
        rounded(F.sum(cost(F.col("tokens"))), 6).alias("cost_usd"))


#: Most masks of path templates, of all repositories, that are broadcast.
BROADCAST_MASKS = 50_000
#: Variable segments of a path: ``:id``, ``{id}``, ``<id>``, ``${..}``.
PATH_VARIABLE = r"\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|:\w+"


def path_segments(path: Column) -> Column:
    """Segments of a path, variables as ``*``. Queries and a slash at the end are left out."""
    bare = F.regexp_replace(path, r"[?#].*", "")
    return F.split(F.regexp_replace(
        F.regexp_replace(bare, PATH_VARIABLE, "*"), r"(?<=.)/+$", ""), "/", -1)


def _resolved(paths: DataFrame, templates: DataFrame, rows: int) -> DataFrame:
    """paths(repo, call) and templates(repo, key, mask, n) -> (repo, call, key): the template that
    each path meets, the most specific one (literal segments count from the left).

    A template's mask says which of its segments are variable. A repository has few different masks
    for a length, so a path is tried once per mask: its segments under the mask become ``*``, and what
    comes out is looked up among the templates. No path meets a template it does not match.
    """
    masks = saved(templates.select("repo", "n", "mask").distinct(), "masks")
    split = paths.withColumn("segs", path_segments(F.col("call"))).withColumn("n", F.size("segs"))
    if masks.count() <= BROADCAST_MASKS:
        dealt, spread = split.withColumn("salt", F.lit(0)), F.broadcast(masks.withColumn("salt", F.lit(0)))
    else:
        dealt, spread = salted(split, masks, ["repo", "n"], ["call"], rows)
    masked = F.transform("segs", lambda s, i: F.when(
        F.substring("mask", i + 1, F.lit(1)) == "1", F.lit("*")).otherwise(s))
    tried = dealt.join(spread, ["repo", "n", "salt"]).select(
        "repo", "call", "mask", F.array_join(masked, "/").alias("key"))
    met = tried.join(templates.select("repo", "mask", "key").distinct(), ["repo", "mask", "key"], "left_semi")
    return met.groupBy("repo", "call").agg(F.min_by("key", "mask").alias("key"))


def callers_of(units: DataFrame, rows: int = ROWS_PER_SALT) -> DataFrame:
    """Which units call which endpoints: (repo, path, endpoint, caller, call). A call meets an
    endpoint whose path has as many segments, each equal to the call's or variable (``:id``, ``{id}``,
    ``<id>``, ``${..}``): ``/users/42`` and ``/users/${id}`` meet ``/users/:id``. Of several paths the
    most specific one is met, as a router would choose. Queries are ignored.

    A path that very many units call is one join key, which is dealt out by a salt. ``units`` are read
    several times and should be saved."""
    variable = lambda s: F.when(s == "*", F.lit("1")).otherwise(F.lit("0"))
    ends = units.where((F.col("type") == "endpoint") & F.col("extra.path").isNotNull()).select(
        "repo", F.col("extra.path").alias("path"), F.col("id").alias("endpoint"),
        path_segments(F.col("extra.path")).alias("segs")).select(
        "repo", "path", "endpoint", F.array_join("segs", "/").alias("key"),
        F.array_join(F.transform("segs", variable), "").alias("mask"), F.size("segs").alias("n"))
    calls = units.select("repo", F.col("id").alias("caller"), F.explode("extra.calls").alias("call"))
    met = saved(_resolved(calls.select("repo", "call").distinct(), ends, rows), "resolved")
    dealt, spread = salted(met, ends.select("repo", "path", "endpoint", "key"), ["repo", "key"], ["call"], rows)
    targets = saved(dealt.join(spread, ["repo", "key", "salt"]).select(
        "repo", "call", "path", "endpoint"), "targets")
    dealt, spread = salted(calls, targets, ["repo", "call"], ["caller"], rows)
    return dealt.join(spread, ["repo", "call", "salt"]).select(
        "repo", "path", "endpoint", "caller", "call")
