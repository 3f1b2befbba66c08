"""Last line of the block that starts on a line, over the array of lines of one file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codelode.functions.hof import bind, first_index, last_index
from codelode.functions.regex import rx, trim
from codelode.operators.limits import UNLIMITED, lines_of, stretches

# Literals that hide brackets, lines that go on.
BLOCK_COMMENT = r"/\*.*?\*/"
QUOTED = r"""(["'`])(?:\\.|(?!\1)[^\\])*?\1"""
LINE_COMMENT = r"//.*$"
HASH_COMMENT = r"#.*$"
SQL_COMMENT = r"--.*$"
CONTINUES = ["=", "(", ",", ".", "+", "-", "*", "/", "&", "|", "?", ":"]
BRACKET_LINE = r"^[{}()[\];,]*$|^end[;.]?$"
# Fixed values end.


def strip_literals(line: Column, hash_comments: Column) -> Column:
    """Line without comments and with quoted text emptied."""
    s = F.regexp_replace(line, rx(BLOCK_COMMENT), " ")
    s = F.regexp_replace(s, rx(QUOTED), '""')
    s = F.regexp_replace(s, rx(LINE_COMMENT), "")
    return F.when(hash_comments, F.regexp_replace(s, rx(HASH_COMMENT), "")).otherwise(s)


def bracket_counts(line: Column, hash_comments: Column) -> Column:
    """struct(opens, net, goes_on): opening brackets, opening minus closing, and whether
    the code on the line ends with a token that continues on the next one."""
    code = F.when(line.rlike("[\"'`/#]"), strip_literals(line, hash_comments)).otherwise(line)

    def count(s: Column) -> Column:
        opens = F.length(s) - F.length(F.translate(s, "{([", ""))
        closes = F.length(s) - F.length(F.translate(s, "})]", ""))
        tail = trim(s)
        return F.struct(
            opens.alias("opens"), (opens - closes).alias("net"),
            (F.right(tail, F.lit(1)).isin(CONTINUES) | (F.right(tail, F.lit(2)) == "=>")).alias(
                "goes_on"))

    return bind(code, count)


def _indent_stop(lines: Column, pos: Column, indent: Column, limit: int | None) -> Column:
    """The first line behind ``pos`` that is not more indented."""
    return pos + 1 + first_index(
        lines, pos + 1, stretches(limit), lambda m: (m["t"] != "") & (m["indent"] <= indent))


def _last_line(lines: Column, pos: Column, limit: int | None) -> Column:
    return F.least(F.size(lines) - 1, pos + lines_of(limit))


def _indent_end(lines: Column, pos: Column, stop: Column, limit: int | None) -> Column:
    """Everything more indented than the first line belongs to the block, but for blank lines at
    the end."""
    reach = F.coalesce(stop - 1, _last_line(lines, pos, limit))
    return bind(reach, lambda r: last_index(
        lines, r, stretches(None, 3), lambda m: m["t"] != ""))


def brace_end(lines: Column, brackets: Column, pos: Column, limit: int | None) -> Column:
    """First line at which everything opened since ``pos`` is closed again."""
    follow = first_index(lines, pos + 1, [2, 32, UNLIMITED], lambda m: m["t"] != "") + pos + 1
    opens_below = F.coalesce(F.startswith(F.get(lines, follow)["t"], F.lit("{")), F.lit(False))

    def walk(n: Column, below: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("k"),
            F.lit(None).cast("int").alias("end"))

        def step(acc: Column, b: Column) -> Column:
            depth = acc["depth"] + b["net"]
            opened = acc["opened"] | (b["opens"] > 0)
            t = F.get(lines, pos + acc["k"])["t"]
            end = F.when(
                opened, F.when((depth <= 0) & ~b["goes_on"] & ~((acc["k"] == 0) & below),
                               pos + acc["k"])
            ).when((acc["k"] > 0) & (t != "") & ~F.startswith(t, F.lit("{")), pos)
            return F.when(acc["end"].isNotNull(), acc).otherwise(F.struct(
                depth.cast("int").alias("depth"), opened.alias("opened"),
                (acc["k"] + 1).alias("k"), end.cast("int").alias("end")))

        return F.aggregate(F.slice(brackets, pos + 1, n), start, step, lambda a: a["end"])

    tiers = F.array(*[F.lit(n) for n in (*stretches(limit)[:-1], lines_of(limit) + 1)])
    return bind(opens_below, lambda below: F.aggregate(
        tiers, F.lit(None).cast("int"), lambda found, n: F.when(
            found.isNotNull(), found).otherwise(walk(n, below))))


def keyword_end(lines: Column, pos: Column, indent: Column, limit: int | None) -> Column:
    """Block closed by a line ``end`` at the same indent."""
    t = F.get(lines, pos)["t"]
    one_line = t.rlike(rx(r"\bend\s*$")) | t.rlike(rx(r"^def\s+[\w?!=.]+\s*="))
    ends = lambda m: (m["indent"] == indent) & m["t"].rlike(rx(r"^end\b"))
    stop = first_index(lines, pos + 1, stretches(limit), lambda m: (m["t"] != "") & (
        ends(m) | (m["indent"] < indent)))

    def at(k: Column) -> Column:
        j = pos + 1 + k
        return F.when(F.get(lines, j)["indent"] == indent, j).otherwise(j - 1)

    return F.when(one_line, pos).otherwise(bind(stop, at))


def semicolon_end(lines: Column, pos: Column, limit: int | None) -> Column:
    """First line with a semicolon outside literals and comments."""
    has = lambda m: F.contains(m["l"], F.lit(";")) & F.contains(F.regexp_replace(
        strip_literals(m["l"], F.lit(False)), rx(SQL_COMMENT), ""), F.lit(";"))
    return pos + first_index(lines, pos, [*stretches(limit)[:-1], lines_of(limit) + 1], has)


def block_end(
    lines: Column, brackets: Column, pos: Column, indent: Column, mode: Column,
    limit: int | None = None,
) -> Column:
    """struct(end, cut): the 0-based last line of the block that starts at ``pos``, and whether the
    limit ended it. ``mode`` is how blocks end in the language; one that does not end that way ends
    where the indent does."""
    found = (
        F.when(mode == "indent", F.lit(None).cast("int"))
        .when(mode == "end", keyword_end(lines, pos, indent, limit))
        .when(mode == "semicolon", semicolon_end(lines, pos, limit))
        .otherwise(brace_end(lines, brackets, pos, limit)))

    def ended(end: Column, cut: Column) -> Column:
        return F.struct(end.cast("int").alias("end"), cut.alias("cut"))

    more = F.size(lines) - 1 > pos + lines_of(limit)
    by_indent = bind(_indent_stop(lines, pos, indent, limit), lambda stop: ended(
        _indent_end(lines, pos, stop, limit), stop.isNull() & more))
    return bind(found, lambda end: F.when(end.isNotNull(), ended(end, F.lit(False))).when(
        mode == "semicolon", ended(_last_line(lines, pos, limit), more)).otherwise(by_indent))


def member_indent(lines: Column, pos: Column, end: Column, indent: Column) -> Column:
    """Indent of the direct members of the container pos..end."""
    first = first_index(lines, pos + 1, stretches(None), lambda m: (m["t"] != "") & (
        m["t"] != "{") & (m["indent"] > indent)) + pos + 1
    return bind(first, lambda j: F.when(j <= end, F.get(lines, j)["indent"]).otherwise(indent + 1))


def scope_end(lines: Column, pos: Column, end: Column, indent: Column) -> Column:
    """Last line at which the container is still open: its block end, or the line before
    the first dedented line that is more than closing brackets."""
    dedent = first_index(lines, pos + 1, stretches(None), lambda m: (m["t"] != "") & (
        m["indent"] <= indent) & ~m["t"].rlike(rx(BRACKET_LINE)), most=end - pos)
    return F.least(end, F.coalesce(pos + dedent, end)).cast("int")
