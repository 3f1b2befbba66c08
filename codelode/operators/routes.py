"""Which component is shown on which route: the route table of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.hof import bind
from codelode.functions.regex import rx
from codelode.operators.limits import Limits, lines_of

# Forms of a route declaration.
ROUTE_GATE = r"<Route\b|\bpath\s*:"
ROUTE_TAG = r"<Route\b"
TAG_PATH = r"""\bpath=(?:["']([^"']+)["']|\{\s*["'`]([^"'`]+)["'`]\s*\})"""
TAG_COMPONENT = [r"\bcomponent=\{\s*(\w+)\s*\}", r"\belement=\{\s*<(\w+)",
                 r"\brender=\{[^<]*<(\w+)"]
ROUTE_OBJECT = (
    r"""\{[^{}]*?\bpath\s*:\s*['"`]([^'"`]+)['"`][^{}]*?\b(?:element\s*:\s*<(\w+)"""
    r"|(?:component|Component)\s*:\s*(\w+))"
)
ROUTE_OBJECT_REVERSED = (
    r"\{[^{}]*?\b(?:element\s*:\s*<(\w+)[^{}]*?|(?:component|Component)\s*:\s*(\w+)[^{}]*?)"
    r"""\bpath\s*:\s*['"`]([^'"`]+)['"`]"""
)
# Fixed values end.

ROUTE_TYPE = "array<struct<component:string,route:string>>"


def _first_group(text: Column, pattern: str, groups: list[int]) -> Column:
    found = [F.nullif(F.regexp_extract(text, rx(pattern), g), F.lit("")) for g in groups]
    return F.coalesce(*found)


def _tag_attributes(rest: Column) -> Column:
    """Text up to the first ``>`` outside braces; NULL when there is none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"),
                     F.lit(False).alias("done"), F.lit(0).alias("n"))

    def braces(s: Column) -> Column:
        return (F.length(F.translate(s, "}", "")) - F.length(F.translate(s, "{", ""))).cast("int")

    pieces = F.split(rest, ">")

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + braces(piece)
        text = F.when(acc["n"] == 0, piece).otherwise(
            F.concat(acc["text"], F.lit(">"), piece))
        return F.when(acc["done"], acc).otherwise(F.struct(
            depth.alias("depth"), text.alias("text"), (depth <= 0).alias("done"),
            (acc["n"] + 1).alias("n")))

    # The last piece is not followed by ">".
    return bind(pieces, lambda p: F.aggregate(
        F.slice(p, 1, F.size(p) - 1), start, step,
        lambda a: F.when(a["done"], a["text"])))


def _from_tags(text: Column, unclosed: int | None) -> Column:
    def of(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            # A tag usually closes before the next one starts; if not, read on.
            rest = F.array_join(F.slice(pieces, i + 2, F.size(pieces)), "<Route")
            attrs = F.coalesce(_tag_attributes(piece), _tag_attributes(rest),
                               F.substring(rest, 1, lines_of(unclosed)))
            return bind(attrs, lambda a: F.struct(
                F.coalesce(*[_first_group(a, p, [1]) for p in TAG_COMPONENT]).alias("component"),
                _first_group(a, TAG_PATH, [1, 2]).alias("route")))

        return F.transform(F.slice(pieces, 2, F.size(pieces)), one)

    return bind(F.split(text, rx(ROUTE_TAG)), of)


def _from_objects(text: Column, pattern: str, name: list[int], route: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(0))
    return F.transform(found, lambda m: F.struct(
        _first_group(m, pattern, name).alias("component"),
        _first_group(m, pattern, [route]).alias("route")))


def file_routes(text: Column, limits: Limits = Limits()) -> Column:
    """Routes declared in one file, in order of precedence; NULL for most files. A tag reaches to its
    end, however long it is; one that never ends is read up to a limit."""
    found = F.concat(
        _from_tags(text, limits.unclosed_tag_chars).cast(ROUTE_TYPE),
        _from_objects(text, ROUTE_OBJECT, [2, 3], 1).cast(ROUTE_TYPE),
        _from_objects(text, ROUTE_OBJECT_REVERSED, [1, 2], 3).cast(ROUTE_TYPE))
    return F.when(text.rlike(rx(ROUTE_GATE)), F.filter(
        found, lambda r: r["component"].isNotNull() & r["route"].isNotNull()))


def first_routes(declared: DataFrame) -> DataFrame:
    """declared(repo, file, routes array) -> routes(repo, component, route). The first
    declaration in path order wins; ``min_by`` is combined before the shuffle, so a component
    declared in very many files is no hot key."""
    rows = declared.select("repo", "file", F.posexplode(F.filter(
        "routes", lambda r: r["component"].isNotNull())))
    return rows.groupBy("repo", F.col("col.component").alias("component")).agg(
        F.min_by("col.route", F.struct("file", "pos")).alias("route"))


def route_table(files: DataFrame) -> DataFrame:
    """files(repo, path, text) -> routes(repo, component, route)."""
    gated = files.where(F.col("text").rlike(rx(ROUTE_GATE)))
    return first_routes(gated.select(
        "repo", F.col("path").alias("file"), file_routes(F.col("text")).alias("routes")))
