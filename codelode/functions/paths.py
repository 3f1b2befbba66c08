"""Column expressions over file paths: language, globs, areas, ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from codelode.operators.rules import EXTENSIONS


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def detect_lang(path: Column) -> Column:
    """Language by the extension after the last dot; NULL for dotfiles and others."""
    ext = F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)\z", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, ext)


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob (``**``, ``*``, ``?``), not anchored."""
    def part(m: re.Match) -> str:
        token = m.group()
        known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        return known.get(token) or re.escape(token)

    return re.sub(r"\*\*/|\*\*|.", part, pattern, flags=re.S)


def _clean_glob(pattern: str) -> str:
    p = pattern.replace("\\", "/")
    p = p.removeprefix("./")
    p = p.removeprefix("/")
    return p.removesuffix("/")


def glob_match(path: Column, pattern: str) -> Column:
    """Does the glob match the path? Without a slash the glob is tried on every path
    segment, with a slash on the path and on each directory above it."""
    glob = _clean_glob(pattern)
    if not glob:
        return F.lit(False)
    rel = F.regexp_replace(posix(path), r"^\./", "")
    if "/" in glob:
        return rel.rlike(rf"^(?:{glob_regex(glob)})(?:/.*)?\z")
    segment = glob_regex(glob).replace("(?:.*/)?", "[^/]*").replace(".*", "[^/]*")
    return rel.rlike(rf"(?:^|/)(?:{segment})(?:/|\z)")


def any_glob(path: Column, patterns: list[str]) -> Column:
    """True when one of the globs matches. All globs without a slash share one pattern,
    and so do all globs with one, so a path is searched at most twice."""
    bare, rooted = [], []
    for pattern in patterns:
        glob = _clean_glob(pattern)
        if not glob:
            continue
        if "/" in glob:
            rooted.append(glob_regex(glob))
        else:
            bare.append(glob_regex(glob).replace("(?:.*/)?", "[^/]*").replace(".*", "[^/]*"))
    rel = F.regexp_replace(posix(path), r"^\./", "")
    tests = []
    if bare:
        tests.append(rel.rlike(rf"(?:^|/)(?:{'|'.join(bare)})(?:/|\z)"))
    if rooted:
        tests.append(rel.rlike(rf"^(?:{'|'.join(rooted)})(?:/.*)?\z"))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def glob_regex_of(pattern: Column) -> Column:
    """:func:`glob_match` for a glob held in a column: an anchored regular expression to
    use with ``rlike``; NULL for an empty glob."""
    glob = F.regexp_replace(posix(pattern), r"^\./", "")
    glob = F.regexp_replace(glob, r"^/", "")
    glob = F.regexp_replace(glob, r"/\z", "")
    safe = F.regexp_replace(glob, r"([.+^$()\[\]{}|\\])", r"\\$1")
    marked = F.regexp_replace(safe, r"\*\*/", "\u0001")
    marked = F.regexp_replace(marked, r"\*\*", "\u0002")
    marked = F.regexp_replace(marked, r"\*", "[^/]*")
    marked = F.regexp_replace(marked, r"\?", "[^/]")
    rooted = F.replace(F.replace(marked, F.lit("\u0001"), F.lit("(?:.*/)?")),
                       F.lit("\u0002"), F.lit(".*"))
    bare = F.replace(marked, F.lit("\u0002"), F.lit("[^/]*"))
    return F.when(glob != "", F.when(
        F.contains(glob, F.lit("/")), F.concat(F.lit("^(?:"), rooted, F.lit(r")(?:/.*)?\z"))
    ).otherwise(F.concat(F.lit("(?:^|/)(?:"), bare, F.lit(r")(?:/|\z)"))))


def area_of(path: Column, areas: list[tuple[str, str]] = ()) -> Column:
    """Functional area: ordered (pattern, name) pairs tried on the base name, then on the
    whole path; else the first directory, else ``root``. Broken patterns are skipped."""
    rel = posix(path)
    usable = []
    for pattern, name in areas:
        try:
            re.compile(pattern)
        except re.error:
            continue
        usable.append((f"(?i){pattern}", name))
    tests = [F.when(target.rlike(p), F.lit(name))
             for target in (basename(path), rel) for p, name in usable]
    first_dir = F.when(F.instr(rel, "/") > 1, F.substring_index(rel, "/", 1))
    return F.coalesce(*tests, first_dir, F.lit("root"))
