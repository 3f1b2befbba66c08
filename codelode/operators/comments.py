"""Comments of a unit and of a file, over the array of lines of one file.

``lines`` is the array built by ``operators.extract.line_array``: structs with the raw
line ``l``, the trimmed line ``t``, the indent and the flags ``cmt`` (starts with a line
comment) and ``dec`` (decorator line). ``pairs`` holds the block comment delimiters of the
language (``operators.rules.language_columns``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codelode.functions.hof import bind, first_index, last_index
from codelode.functions.regex import rx, squeeze, trim
from codelode.operators.limits import Limits, lines_of, stretches

# What is cleaned out of comments.
DECORATION = r"^[\s=\-*#/~_+|:.]*$"
TAG_LINE = (
    r"^(@\w|eslint-|prettier-|noqa|type:\s|pylint:|istanbul\s|ts-ignore|ts-expect-error|@ts-)"
)
LINE_PREFIX = r"^(?://|#|--)[/#!\-]*"
SIGNATURE_END = r":\s*(#.*)?$"
# Fixed values end.

def join_comment(parts: Column) -> Column:
    """One line of text: empty, decorative and tag lines dropped, spaces squeezed."""
    trimmed = F.transform(parts, trim)
    kept = F.filter(trimmed, lambda x: (x != "") & ~x.rlike(rx(DECORATION)) & ~x.rlike(rx(TAG_LINE)))
    return squeeze(F.array_join(kept, " "))


def _drop_end(s: Column, ending: Column) -> Column:
    kept = F.substring(s, F.lit(1), F.length(s) - F.length(ending))
    return F.when(F.endswith(s, ending), kept).otherwise(s)


def _line_texts(lines: Column, first: Column, last: Column) -> Column:
    """Texts of the line comments first..last (0-based, inclusive)."""
    run = F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.transform(run, lambda m: trim(F.regexp_replace(m["t"], LINE_PREFIX, "")))


def _block_texts(lines: Column, first: Column, last: Column, open_: Column, close: Column) -> Column:
    """Texts of the block comment lines first..last without delimiters and stars."""
    size = last - first + 1

    def clean(m: Column, i: Column) -> Column:
        s = m["t"]
        s = F.when((i == 0) & F.startswith(s, open_), F.substring(
            s, F.length(open_) + 1, F.length(s))).otherwise(s)
        s = F.when(i == size - 1, _drop_end(s, close)).otherwise(s)
        s = F.regexp_replace(s, rx(r"^\*+\s?"), "")
        s = trim(F.regexp_replace(s, rx(r"^!+\s?"), ""))
        return trim(_drop_end(s, close))

    return F.transform(F.slice(lines, first + 1, size), clean)


def _closed_on_line(t: Column, open_: Column, close: Column) -> Column:
    """Does a line that ends with ``close`` also hold the whole block comment?"""
    return (
        F.startswith(t, open_)
        & (F.length(t) >= F.length(open_) + F.length(close))
        & ((open_ != close) | (F.length(t) > F.length(open_)))
    )


def _block_above(lines: Column, last: Column, pair: Column, limit: int | None) -> Column:
    open_, close = pair["open"], pair["close"]
    t = F.get(lines, last)["t"]
    opener = last_index(lines, last - 1, stretches(None if limit is None else limit - 1, 6),
                        lambda m: F.startswith(m["t"], open_))
    first = F.when(_closed_on_line(t, open_, close), last).otherwise(opener)
    return F.when(F.endswith(t, close), bind(first, lambda k: F.when(
        k.isNotNull(), join_comment(_block_texts(lines, k, last, open_, close)))))


def comment_above(lines: Column, pos: Column, pairs: Column, limit: int | None) -> Column:
    """Comment right above line ``pos``: a run of line comments, or a block comment of at most
    ``limit`` lines whose last line is right above. Decorator lines between are skipped."""
    anchor = F.coalesce(
        last_index(lines, pos - 1, stretches(None, 2), lambda m: ~m["dec"]), F.lit(-1))

    def at(j: Column) -> Column:
        stop = F.coalesce(last_index(
            lines, j, stretches(None, 4), lambda m: ~m["cmt"] | F.startswith(m["t"], F.lit("#!"))),
            F.lit(-1))

        def from_run(k: Column) -> Column:
            blocks = F.transform(pairs, lambda p: _block_above(lines, j, p, limit))
            return (
                F.when(k < j, join_comment(_line_texts(lines, k + 1, j)))
                .when(j < 0, F.lit(""))
                .otherwise(F.coalesce(
                    F.get(F.filter(blocks, lambda b: b.isNotNull()), F.lit(0)), F.lit("")))
            )

        return bind(stop, from_run)

    return bind(anchor, at)


def docstring_below(lines: Column, pos: Column, pairs: Column, limits: Limits) -> Column:
    """Docstring under the signature that starts at ``pos``; empty when there is none."""
    n = F.size(lines)
    signature = lines_of(limits.signature_lines)
    limit = F.least(n - 1, pos + signature)
    colon = first_index(lines, pos, stretches(signature + 1, 1),
                        lambda m: m["l"].rlike(rx(SIGNATURE_END)))

    def body_of(j: Column, pair: Column) -> Column:
        open_, close = pair["open"], pair["close"]
        t = F.get(lines, j)["t"]
        rest = F.substring(t, F.length(open_) + 1, F.length(t))
        closing = first_index(lines, j + 1, stretches(limits.docstring_lines, 4),
                              lambda m: F.endswith(m["t"], close))
        reach = F.least(n - 1, j + lines_of(limits.docstring_lines))
        last = F.coalesce(j + 1 + closing, reach)
        inner = F.transform(
            F.slice(lines, j + 2, F.greatest(last - j, F.lit(0))), lambda m: m["t"])
        whole = F.concat(F.array(rest), F.transform(
            inner, lambda s, i: F.when(closing.isNotNull() & (i == last - j - 1),
                                       _drop_end(s, close)).otherwise(s)))
        return F.when(F.startswith(t, open_), F.when(
            F.endswith(rest, close), join_comment(F.array(_drop_end(rest, close)))
        ).otherwise(join_comment(whole)))

    def after_colon(c: Column) -> Column:
        start = pos + c + 1
        first = first_index(lines, start, stretches(limits.signature_lines, 2), lambda m: m["t"] != "") + start
        return bind(first, lambda j: F.when(j <= limit, F.coalesce(F.get(F.filter(
            F.transform(pairs, lambda p: body_of(j, p)),
            lambda d: d.isNotNull()), F.lit(0)), F.lit(""))))

    return F.coalesce(bind(colon, after_colon), F.lit(""))


def file_header(lines: Column, pairs: Column, limit: int | None) -> Column:
    """Comment block at the top of the file, after blank lines and a shebang."""
    n = F.size(lines)
    begin = first_index(lines, F.lit(0), stretches(None, 4),
                        lambda m: (m["t"] != "") & ~F.startswith(m["l"], F.lit("#!")))

    def block(i: Column, pair: Column) -> Column:
        open_, close = pair["open"], pair["close"]
        t = F.get(lines, i)["t"]
        same_line = (
            F.endswith(t, close) & (F.length(t) > F.length(open_))
            & (F.length(t) >= F.length(open_) + F.length(close))
        )
        closing = first_index(lines, i + 1, stretches(None if limit is None else limit - 1, 8),
                              lambda m: F.endswith(m["t"], close)) + i + 1
        last = F.when(same_line, i).otherwise(closing)
        return F.when(F.startswith(t, open_), bind(last, lambda j: F.when(
            j.isNull(), F.lit("")).otherwise(
                join_comment(_block_texts(lines, i, j, open_, close)))))

    def at(i: Column) -> Column:
        run = F.coalesce(first_index(lines, i, stretches(None, 8), lambda m: ~m["cmt"]), n - i)
        blocks = F.transform(pairs, lambda p: block(i, p))
        return F.when(i.isNull(), F.lit("")).when(
            F.get(lines, i)["cmt"], join_comment(_line_texts(lines, i, i + run - 1))
        ).otherwise(F.coalesce(
            F.get(F.filter(blocks, lambda b: b.isNotNull()), F.lit(0)), F.lit("")))

    return bind(begin, at)
