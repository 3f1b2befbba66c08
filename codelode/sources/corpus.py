"""Corpora of source files: reading them and choosing which files to scan.

Everything here is a filter or projection on files(repo, path, text, size); filters on
path and size reach the reader, so excluded contents are never loaded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelode.functions import paths as P
from codelode.functions.hof import bind
from codelode.functions.regex import trim
from codelode.sources.scratch import saved

# What is never scanned, and the size limits of source text.
DEFAULT_EXCLUDES = [
    ".git", ".hg", ".svn", "node_modules", "bower_components", "dist", "build", "out",
    "coverage", "vendor", "__pycache__", ".venv", "venv", "target", ".next", ".nuxt", ".cache",
    ".idea", ".vscode", ".pytest_cache", ".mypy_cache", ".tox", "*.min.js", "*.min.css",
    "*.map", "*.bundle.js", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock",
    "Cargo.lock", "Gemfile.lock", "poetry.lock", "Pipfile.lock", "go.sum", "*.png", "*.jpg",
    "*.jpeg", "*.gif", "*.ico", "*.svg", "*.webp", "*.bmp", "*.tif", "*.tiff", "*.pdf", "*.zip",
    "*.gz", "*.tar", "*.tgz", "*.7z", "*.rar", "*.bz2", "*.xz", "*.woff", "*.woff2", "*.ttf",
    "*.eot", "*.otf", "*.mp3", "*.mp4", "*.mov", "*.avi", "*.wav", "*.ogg", "*.webm", "*.exe",
    "*.dll", "*.so", "*.dylib", "*.class", "*.jar", "*.war", "*.pyc", "*.pyo", "*.wasm",
    "*.bin", "*.db", "*.sqlite", "*.sqlite3", "*.o", "*.a", "*.obj", "*.lib",
]
MAX_FILE_BYTES = 1024 * 1024
MINIFIED_LINE = 2000
MINIFIED_MEAN = 300
# Fixed values end.

DEFAULT_OUT = ".codelode"
SCHEME = r"^[a-z0-9+.-]+:/*"


def load_files(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """files(repo, path, size, text) under a directory. With ``repo`` the directory is one
    repository; without, its first-level directories are the repositories. Nothing is dropped
    here; a filter on ``size`` reaches the reader, so contents it excludes are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(SCHEME, "/", root.rstrip("/")) + "/"
    local = F.regexp_replace(F.col("path"), SCHEME, "/")
    rel = F.substring(local, F.lit(len(base) + 1), F.length(local))
    if repo is not None:
        keys = [F.lit(repo).alias("repo"), rel.alias("path")]
    else:
        keys = [F.substring_index(rel, "/", 1).alias("repo"),
                F.regexp_replace(rel, "^[^/]*/", "").alias("path")]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(*keys, F.col("length").alias("size"), text.alias("text"))


def exclude_default(files: DataFrame, exclude: list[str] = (), out: str = DEFAULT_OUT) -> DataFrame:
    """Drop what the built-in and the given globs match, and the output directory."""
    patterns = [*DEFAULT_EXCLUDES, *exclude]
    if out and not out.startswith("/"):
        patterns.append(out.replace("\\", "/").rstrip("/"))
    return files.where(~P.any_glob(F.col("path"), patterns))


def include_filter(files: DataFrame, include: list[str] = ()) -> DataFrame:
    """With any include glob, keep matching paths only."""
    return files.where(P.any_glob(F.col("path"), list(include))) if include else files


def explicitly_included(path: Column, include: list[str]) -> Column:
    """Included by a glob that names something, not by a bare ``*`` or ``**`` at its end."""
    named = [p for p in include if not re.search(r"(^|/)\*\*?$", p)]
    return P.any_glob(path, named)


def language_gate(files: DataFrame, include: list[str] = ()) -> DataFrame:
    """Drop files of no known language unless they are explicitly included."""
    path = F.col("path")
    return files.where(P.detect_lang(path).isNotNull() | explicitly_included(path, list(include)))


def size_cap(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files of at most ``max_bytes``; :func:`oversized` has the others."""
    return files.where(F.col("size") <= max_bytes)


def oversized(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(repo, path, size) of the files that :func:`size_cap` drops."""
    return files.where(F.col("size") > max_bytes).select("repo", "path", "size")


def dedup_paths(files: DataFrame) -> DataFrame:
    """One row per path. Of several the smallest one by size, then text, stays; tables have no
    order in which one could come first."""
    rest = [F.struct(*[c for c in ("size", "text") if c in files.columns],
                     *[c for c in files.columns if c not in ("repo", "path", "size", "text")])]
    if files.columns == ["repo", "path"]:
        return files.distinct()
    one = files.groupBy("repo", "path").agg(F.min(rest[0]).alias("_f")).select("repo", "path", "_f.*")
    return one.select(*files.columns)


def list_files(
    files: DataFrame, include: list[str] = (), exclude: list[str] = (), out: str = DEFAULT_OUT,
    unique: bool = False, max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """The files to scan. ``unique``: the input already has one row per path, as a file
    listing does, and the shuffle of :func:`dedup_paths` is saved."""
    chosen = size_cap(language_gate(
        include_filter(exclude_default(files, exclude, out), include), include), max_bytes)
    return chosen if unique else dedup_paths(chosen)


def is_minified(text: Column) -> Column:
    """A line over 2000 characters, or lines of more than 300 characters on average."""
    def of(t: Column) -> Column:
        return F.when(F.coalesce(t, F.lit("")) == "", F.lit(False)).otherwise(bind(
            F.split(t, "\n", -1), lambda ls: F.exists(ls, lambda line: F.length(line) > MINIFIED_LINE) | (
                (F.length(t) - F.size(ls) + 1) / F.size(ls) > MINIFIED_MEAN)))

    return bind(text, of)


def explode_lines(files: DataFrame) -> DataFrame:
    """lines(repo, path, pos, line): 0-based; a final line end leaves an empty last line."""
    return files.select("repo", "path", F.posexplode(F.split("text", r"\r?\n", -1)).alias(
        "pos", "line"))


def parse_ignore(text: Column) -> Column:
    """Ignore file -> array of struct(pattern, negate)."""
    def entry(line: Column) -> Column:
        bare = trim(F.regexp_replace(line, r"(^|[^\\])#.*\z", "$1"))
        negate = F.startswith(bare, F.lit("!"))
        pattern = F.when(negate, F.substring(bare, F.lit(2), F.length(bare))).otherwise(bare)
        return F.struct(
            F.regexp_replace(pattern, r"\\([# !])", "$1").alias("pattern"), negate.alias("negate"))

    entries = F.transform(F.split(text, r"\r?\n", -1), entry)
    return F.filter(entries, lambda e: e["pattern"] != "")


def _either(patterns: Column) -> Column:
    """One pattern for several, some of them NULL; NULL for none."""
    return bind(F.array_compact(patterns), lambda ps: F.when(F.size(ps) > 0, F.array_join(
        F.transform(ps, lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")))


def compiled_rules(rules: Column) -> Column:
    """Ordered rules (array of pattern, negate) as an array of runs of rules with the same effect:
    struct(negate, regex, dir_regex). Since the last matching rule decides, the rules of a run are
    one pattern; ``dir_regex`` is that of the rules for directories only."""
    each = F.transform(rules, lambda r: F.struct(
        P.glob_regex_of(r["pattern"]).alias("regex"),
        F.endswith(r["pattern"], F.lit("/")).alias("dir_only"), r["negate"].alias("negate")))

    def runs(rs: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(rs) - 1), lambda i: (i == 0) | (
            F.get(rs, i)["negate"] != F.get(rs, i - 1)["negate"]))
        return bind(first, lambda at: F.transform(at, lambda i, k: bind(F.slice(
            rs, i + 1, F.coalesce(F.get(at, k + 1), F.size(rs)) - i), lambda run: F.struct(
                F.get(run, F.lit(0))["negate"].alias("negate"),
                _either(F.transform(run, lambda r: r["regex"])).alias("regex"),
                _either(F.transform(F.filter(run, lambda r: r["dir_only"]), lambda r: r["regex"]))
                .alias("dir_regex")))))

    return bind(each, runs)


def rules_drop(path: Column, compiled: Column, is_dir: bool) -> Column:
    """Do the compiled rules drop the path, of a file or directory, by itself? The last matching
    rule decides. Directories above it are not looked at."""
    def step(acc: Column, r: Column) -> Column:
        below = F.rlike(F.concat(path, F.lit("/_")), r["regex"] if is_dir else r["dir_regex"])
        hit = F.rlike(path, r["regex"]) | F.coalesce(below, F.lit(False))
        return F.when(F.coalesce(hit, F.lit(False)), ~r["negate"]).otherwise(acc)

    return F.aggregate(compiled, F.lit(False), step)


def _folders(path: Column) -> Column:
    """The directory of a path and all above it."""
    return bind(F.split(path, "/"), lambda s: F.transform(
        F.slice(s, 1, F.size(s) - 1), lambda _, i: F.array_join(F.slice(s, 1, i + 1), "/")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A saved table, broadcast when it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ignore_filter(files: DataFrame, rules: DataFrame, broadcast_repos: int = 50_000) -> DataFrame:
    """Drop ignored files: rules(repo, rule_no, pattern, negate), one small ordered list per
    repository (an ignore file is itself a capped file). What lies below an ignored directory stays
    ignored, whatever later rules say.

    Repositories with equal rules share a rule set. Directories are a table of their own: each
    is tried once per rule set, and those that are dropped are passed down to the directories below.
    A file then needs a lookup of its directory and the rules for its own path. Tables that are
    joined to the files are broadcast up to ``broadcast_repos`` rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rule_no", "pattern", "negate")))
    lists = rules.groupBy("repo").agg(ordered.alias("_rules")).select("repo", F.transform(
        "_rules", lambda r: F.struct(r["pattern"].alias("pattern"), r["negate"].alias("negate")))
        .alias("_rules"))
    lists = saved(lists.withColumn("_set", F.sha2(F.to_json("_rules"), 256)), "rules")
    sets = saved(lists.groupBy("_set").agg(F.first("_rules").alias("r")).select(
        "_set", compiled_rules(F.col("r")).alias("_compiled")), "rule_sets")
    by_repo = _small(lists.select("repo", "_set"), broadcast_repos)
    sets = _small(sets, broadcast_repos)

    folder = F.regexp_extract(P.posix(F.col("path")), r"^(.*)/", 1)
    dirs = saved(files.select("repo", folder.alias("_dir")).where("_dir <> ''").distinct()
                 .join(by_repo, "repo").select("_set", "_dir").distinct(), "directories")
    inside = dirs.select("_set", "_dir", F.explode(
        _folders(F.concat("_dir", F.lit("/")))).alias("_above"))
    tried = inside.select("_set", "_above").distinct().join(sets, "_set")
    dropped = saved(tried.where(rules_drop(F.col("_above"), F.col("_compiled"), True))
                    .select("_set", "_above"), "dropped")
    blocked = saved(inside.join(_small(dropped, broadcast_repos), ["_set", "_above"], "left_semi")
                    .select("_set", "_dir").distinct(), "blocked")

    keyed = files.join(by_repo, "repo", "left").withColumn("_dir", folder)
    open_ = keyed.join(_small(blocked, broadcast_repos), ["_set", "_dir"], "left_anti").join(sets, "_set", "left")
    keep = ~F.coalesce(rules_drop(P.posix(F.col("path")), F.col("_compiled"), False), F.lit(False))
    return open_.where(keep).select(*files.columns)


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Rules from the ignore file at the root of every repository."""
    return files.where(F.col("path") == name).select(
        "repo", F.posexplode(parse_ignore(F.col("text"))).alias("rule_no", "rule")
    ).select("repo", "rule_no", "rule.pattern", "rule.negate")


__all__ = [
    "load_files", "oversized", "exclude_default", "include_filter", "language_gate", "size_cap", "dedup_paths",
    "list_files", "is_minified", "explode_lines", "parse_ignore", "compiled_rules", "rules_drop",
    "ignore_filter", "ignore_rules",
]
