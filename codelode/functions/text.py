"""Tokens, stems, keyword score and task splitting (all column expressions)."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, functions as F

from codelode.functions.hof import bind, join_present
from codelode.functions.regex import rx, squeeze, trim

# These word lists decide which tokens count, so they must stay as they are.
STOP_WORDS_EN = (
    "the a an of to and or in on for with from by at as is are be been was were this that "
    "these those it its into not but if then than so we you they our your their all any each "
    "when where how what which who also should must can could would will add remove create "
    "make put new fix change show use using via only just some more less very please need "
    "needs want does did done do has have had may might per about after before over under "
    "out up down off yes no"
).split()
STOP_WORDS_IT = (
    "il lo la i gli le un uno una di a da in con su per tra fra e o che non del della dei "
    "delle degli dello al alla ai alle agli allo dal dalla dai dalle nel nella nei nelle sul "
    "sulla sui sulle come piu meno anche gia poi quando dove cosa fai fa fare metti mettere "
    "aggiungi aggiungere togli togliere crea creare nuovo nuova nuovi nuove questo questa "
    "quello quella questi queste se ma perche cosi ora adesso ogni tutto tutti tutte tutta "
    "sia essere sono era stato stata stati state viene vengono deve devono puo possono vorrei "
    "voglio bisogna serve servono"
).split()
# Fixed values end.

STOP_WORDS = sorted(set(STOP_WORDS_EN) | set(STOP_WORDS_IT))


@cache
def _accent_table() -> tuple[str, str]:
    """``translate`` arguments that fold letters to ASCII: every character whose
    canonical decomposition is one ASCII letter or digit plus combining marks
    U+0300-U+036F, and the marks themselves (dropped). Letters with any other
    decomposition cannot become part of a token, so this is exact for tokens."""
    source, target = [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or 0x0300 <= code <= 0x036F:
            continue
        decomposed = unicodedata.normalize("NFD", chr(code))
        kept = [c for c in decomposed if not 0x0300 <= ord(c) <= 0x036F]
        if decomposed != chr(code) and len(kept) == 1 and kept[0].isascii() and kept[0].isalnum():
            source.append(chr(code))
            target.append(kept[0])
    marks = "".join(chr(c) for c in range(0x0300, 0x0370))
    return "".join(source) + marks, "".join(target)


def fold(col: Column) -> Column:
    """Accented letters to plain letters; pure ASCII text passes through untouched."""
    source, target = _accent_table()
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.translate(text, source, target)
    )


def tokenize(col: Column) -> Column:
    """Folded lower-case tokens longer than 2 characters, camelCase split, without
    stop words; order and duplicates kept."""
    spaced = F.regexp_replace(fold(col), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.lower(spaced), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def _stem_pass(words: Column) -> Column:
    """One round of suffix stripping over an array of words; every step leaves at least 3
    characters. Suffix tests and substrings cost half of what patterns would.

    The last step drops the longest listed suffix, and only that one: when it would leave
    fewer than 3 characters, no shorter suffix is tried.
    """
    def ends(w: Column, *suffixes: str) -> Column:
        return reduce(lambda a, b: a | b, [F.endswith(w, F.lit(x)) for x in suffixes])

    def cut(w: Column, n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    def drop(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n + 3, cut(w, n)).otherwise(w)

    def ies(w: Column) -> Column:
        long_enough = F.endswith(w, F.lit("ies")) & (F.length(w) >= 5)
        return F.when(long_enough, F.concat(cut(w, 3), F.lit("y"))).otherwise(w)

    def plural(w: Column) -> Column:
        shorter = (
            F.when(ends(w, "ers") & (F.length(w) >= 6), cut(w, 3))
            .when(ends(w, "es") & (F.length(w) >= 5), cut(w, 2)).otherwise(drop(w, 1)))
        return F.when(ends(w, "s") & ~ends(w, "ss", "us", "is"), shorter).otherwise(w)

    def verb(w: Column) -> Column:
        return (F.when(ends(w, "ing"), drop(w, 3)).when(ends(w, "ed"), drop(w, 2))
                .when(ends(w, "tion"), drop(w, 4)).otherwise(w))

    def vowel(w: Column) -> Column:
        return F.when(F.right(w, F.lit(1)).isin("a", "e", "i", "o"), drop(w, 1)).otherwise(w)

    def derived(w: Column) -> Column:
        short = F.right(w, F.lit(2)).isin("at", "ut", "it", "al", "ar", "er", "ir")
        return (F.when(short, drop(w, 2)).when(ends(w, "azion", "ament"), drop(w, 5))
                .when(ends(w, "ion", "ent"), drop(w, 3)).when(ends(w, "atur"), drop(w, 4))
                .otherwise(w))

    for step in (ies, plural, verb, vowel, derived):
        words = F.transform(words, step)
    return words


def stem_words(words: Column) -> Column:
    """Rough English and Italian stems of lower-case words, at most four rounds."""
    for _ in range(4):
        words = _stem_pass(words)
    return words


def stem(word: Column) -> Column:
    """Stem of one word."""
    return F.get(stem_words(F.array(F.lower(word))), F.lit(0))


def stems(text: Column) -> Column:
    """Distinct stems of a text. Tokens are made distinct first, so that each word form of
    a long text is stemmed once."""
    return F.array_distinct(stem_words(F.array_distinct(tokenize(text))))


def keyword_score(text: Column, query: Column) -> Column:
    """Number of distinct query stems present in the text. This is for one text and
    one query on the same row; many against many is ``operators.retrieve.prefilter``."""
    return F.size(F.array_intersect(stems(text), stems(query)))


def keyword_score_unit(search_text: Column, name_text: Column, query: Column) -> Column:
    """Keyword score of a unit: half a point more for each stem in its name text."""
    return keyword_score(search_text, query) + F.lit(0.5) * keyword_score(name_text, query)


def _list_text(arr: Column) -> Column:
    return F.array_join(arr, " ")


def unit_search_text() -> Column:
    """Everything the keyword index knows about a unit (columns of the unit table)."""
    return join_present(" ", [
        F.col("id"), F.col("name"), F.col("file"), F.col("area"), description_of(),
        F.col("comment"), F.col("extra.path"), F.col("extra.route"), F.col("extra.parent"),
        _list_text(F.col("extra.tables")), _list_text(F.col("extra.calls")),
        _list_text(F.col("extra.emits")),
    ])


def unit_name_text() -> Column:
    """The fields whose words count one and a half times."""
    return join_present(
        " ", [F.col("name"), F.col("file"), F.col("extra.path"), F.col("extra.route")]
    )


def description_of() -> Column:
    """Description of a unit, else its comment, else the empty string."""
    return F.coalesce(
        F.when(F.col("description") != "", F.col("description")), F.col("comment"), F.lit("")
    )


def _words(col: Column) -> Column:
    return F.filter(F.split(trim(col), rx(r"\s+")), lambda w: w != "")


def looks_composite(col: Column) -> Column:
    """Does the text look like several tasks?"""
    text = F.coalesce(col, F.lit(""))
    return text.rlike(rx(r"[\n;•]|,\s*\w+\s+\w+")) | (F.size(_words(text)) > 14)


# What separates the parts of a task.
TASK_PREFIX = r"^\s*(feat|fix|chore|refactor|docs|style|perf|test|build|ci)(\([^)]*\))?!?:\s*"
TASK_LABELS = r"\b(BE|FE|Backend|Frontend|Fix|Refactor)\s*:"
TASK_SEPARATORS = r"\n+|\s*[;•]\s*|(?:^|\s)[-*]\s+|\s+\d+[.)]\s+|\s+\+\s+"
TASK_CONNECTORS = (
    r"\s+e\s+poi\s+|\s+poi\s+|\s+inoltre\s+|\s+and\s+then\s+|\s+then\s+|\s+also\s+|\s+plus\s+"
)
PART_EDGES = r"^[\s:,;\-–—]+|[\s.:,;]+$"
# Fixed values end.


def split_task(col: Column, most: int | None = None) -> Column:
    """Parts of a task: lines, bullets, numbers, connectors, and commas between
    phrases of two words or more. An array with the trimmed text itself when it does
    not split; the first ``most`` parts, if a limit is given."""
    original = trim(F.coalesce(col, F.lit("")))
    text = F.regexp_replace(original, "(?i)" + rx(TASK_PREFIX), "")
    text = F.regexp_replace(text, rx(TASK_LABELS), "\n")
    clauses = F.flatten(F.transform(
        F.split(text, rx(TASK_SEPARATORS)),
        lambda x: F.split(x, "(?i)" + rx(TASK_CONNECTORS)),
    ))

    def at_commas(clause: Column) -> Column:
        return bind(
            F.split(clause, rx(r"\s*,\s*")),
            lambda pieces: F.when(
                (F.size(pieces) > 1) & F.forall(pieces, lambda p: F.size(_words(p)) >= 2), pieces
            ).otherwise(F.array(clause)),
        )

    pieces = F.transform(
        F.flatten(F.transform(clauses, at_commas)),
        lambda p: F.regexp_replace(p, rx(PART_EDGES), ""),
    )
    usable = F.filter(pieces, lambda p: (F.length(p) >= 8) & (F.size(tokenize(p)) >= 1))

    def first_of_each(parts: Column) -> Column:
        return bind(
            F.transform(parts, lambda p: F.lower(p)),
            lambda keys: F.filter(
                parts, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1
            ),
        )

    parts = bind(usable, first_of_each)
    return bind(parts, lambda p: F.when(
        F.size(p) > 1, p if most is None else F.slice(p, 1, most)).otherwise(F.array(original)))


def task_parts(col: Column, split: str = "heuristic", most: int | None = None) -> Column:
    """Non-empty parts of a task, ``most`` of them if that is given; none for a blank task."""
    whole = trim(F.coalesce(col, F.lit("")))
    if split == "none":
        parts = F.array(whole)
    elif split == "heuristic":
        parts = F.transform(split_task(col, most), trim)
    else:
        raise ValueError(f"unknown split mode {split!r}")
    return F.filter(parts, lambda p: p != "")


def cut(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


__all__ = [
    "STOP_WORDS", "fold", "tokenize", "stem", "stem_words", "stems", "keyword_score", "keyword_score_unit",
    "unit_search_text", "unit_name_text", "description_of", "looks_composite",
    "split_task", "task_parts", "cut", "squeeze",
]
