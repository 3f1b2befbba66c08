"""Units of source files: functions, methods, classes, endpoints, components, pages,
jobs; or the whole file when it has none.

One file is one row and its lines are one array (a file is at most 1 MiB), so mining is a
projection over the scan: no shuffle, no group, nothing that a large repository could
skew. Rules are matched per line; the candidate lines of a file are then folded in order
(``aggregate``), which keeps the open containers, the pending decorators and the route
prefix. Block ends and comments are worked out for accepted candidates only.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions import paths as P
from codelode.functions.hof import bind, bind_as, null_if_empty
from codelode.functions.regex import rx, trim
from codelode.operators import blocks, comments, extras
from codelode.operators.limits import Limits, lines_of
from codelode.operators.routes import file_routes, first_routes
from codelode.operators.rules import (
    LANGUAGES,
    MATCH_TYPE,
    by_language,
    language_columns,
    matches_sql,
)

DECORATED: dict[str, list[str]] = {}
for _name, _spec in LANGUAGES.items():
    if _spec.decorator:
        DECORATED.setdefault(_spec.decorator, []).append(_name)

EXTRA_TYPE = (
    "struct<method:string,path:string,handler:string,parent:string,kind:string,route:string,"
    "tables:array<string>,calls:array<string>,emits:array<string>,imports:array<string>,"
    "middleware:array<string>>"
)
_HEAD_FIELDS = {
    "start": "int", "end": "int", "type": "string", "name": "string", "def_name": "string",
    "method": "string", "path": "string", "handler": "string", "parent": "string",
    "kind": "string", "rest": "string", "is_def": "boolean", "cut": "boolean",
}
_HEAD_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in _HEAD_FIELDS.items()) + ">"
_PENDING_TYPE = "struct<line:int,job:boolean,method:string,path:string>"
_SCOPE_TYPE = "struct<name:string,indent:int,start:int,end:int,member:int>"


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def line_array(raw: Column, lang: Column, matched: Column) -> Column:
    """Lines of a file with their features: raw and trimmed text, indent, whether it is a
    comment or a decorator, and the rules that match it (``matched``, by position)."""
    def is_comment(t: Column) -> Column:
        return (
            (F.col("_slash") & F.startswith(t, F.lit("//")))
            | (F.col("_hash") & F.startswith(t, F.lit("#")))
            | (F.col("_dash") & F.startswith(t, F.lit("--")))
        )

    def is_decorator(line: Column) -> Column:
        return F.coalesce(*[
            F.when(lang.isin(names), line.rlike(rx(pattern)))
            for pattern, names in DECORATED.items()
        ], F.lit(False))

    def features(line: Column, i: Column) -> Column:
        return bind(trim(line), lambda t: F.struct(
            line.alias("l"), t.alias("t"),
            (F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))).alias("indent"),
            is_comment(t).alias("cmt"),
            F.when(t != "", is_decorator(line)).otherwise(False).alias("dec"),
            F.get(matched, i).alias("m"),
        ))

    return F.transform(raw, features)


def _struct(type_: str, fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(type_)


def _null(type_: str) -> Column:
    return F.lit(None).cast(type_)


def unit_heads(lines: Column, brackets: Column, limits: Limits) -> Column:
    """Accepted units of one file, in line order: array of heads (see ``_HEAD_FIELDS``),
    lines 0-based."""
    candidates = F.filter(
        F.transform(lines, lambda m, i: F.struct(
            i.cast("int").alias("pos"), m["indent"].alias("indent"), m["t"].alias("t"),
            m["cmt"].alias("cmt"), m["dec"].alias("dec"), m["m"].alias("m"))),
        lambda c: F.size(F.coalesce(c["m"], F.array().cast(MATCH_TYPE))) > 0)
    max_indent = F.col("_max_indent")

    # What a candidate changes: everything the next one needs, and its own head, if any.
    delta_type = (
        f"struct<scopes:array<{_SCOPE_TYPE}>,pending:{_PENDING_TYPE},prefix:string,last_top:int,"
        f"head:{_HEAD_TYPE}>"
    )
    state_type = delta_type.replace(f"head:{_HEAD_TYPE}", f"out:array<{_HEAD_TYPE}>")
    no_heads = F.array().cast(f"array<{_HEAD_TYPE}>")

    def step(acc: Column, c: Column) -> Column:
        return bind_as(state_type, change(acc, c), lambda d: F.struct(
            d["scopes"].alias("scopes"), d["pending"].alias("pending"),
            d["prefix"].alias("prefix"), d["last_top"].alias("last_top"),
            F.when(d["head"].isNull(), acc["out"]).otherwise(
                F.concat(acc["out"], F.array(d["head"]))).alias("out")))

    def change(acc: Column, c: Column) -> Column:
        pos = c["pos"]
        alive = F.transform(acc["scopes"], lambda s, i: F.when(s["end"] >= pos, i + 1))
        depth = F.coalesce(F.array_max(alive), F.lit(0)).cast("int")

        # A decorator is forgotten when it is too far above, or when a line of code that
        # matches no rule stands between.
        def still_pending(p: Column) -> Column:
            between = F.slice(lines, p["line"] + 2, F.greatest(pos - p["line"] - 1, F.lit(0)))
            broken = F.exists(between, lambda m: (m["t"] != "") & ~m["cmt"] & ~m["dec"] & (
                F.size(F.coalesce(m["m"], F.array().cast(MATCH_TYPE))) == 0))
            return F.when(
                p.isNotNull() & (pos - p["line"] <= lines_of(limits.decorator_lines)),
                F.when(~broken, p))

        before = F.struct(
            F.slice(acc["scopes"], F.lit(1), depth).alias("scopes"),
            F.when((F.size(acc["scopes"]) > 0) & (depth == 0), F.lit("")).otherwise(
                acc["prefix"]).alias("prefix"),
            still_pending(acc["pending"]).alias("pending"),
        )
        return bind(before, lambda b: decide(acc, c, b))

    def decide(acc: Column, c: Column, b: Column) -> Column:
        pos, indent = c["pos"], c["indent"]

        def with_scope(top: Column) -> Column:
            inside = top.isNotNull() & (indent > top["indent"])
            inside = F.coalesce(inside, F.lit(False))

            def applies(r: Column) -> Column:
                placed = F.when(inside, indent == top["member"]).otherwise(
                    ~r["inside_only"] & (indent <= max_indent)
                    & ~((indent > 0) & (pos <= acc["last_top"])))
                return (r["kind"] != "def") | (placed & r["allowed"] & (r["name"] != ""))

            rule = F.get(F.filter(c["m"], applies), F.lit(0))
            return bind(rule, lambda r: apply(acc, c, b, top, inside, r))

        return bind(F.get(b["scopes"], F.size(b["scopes"]) - 1), with_scope)

    def apply(acc, c, b, top, inside, r) -> Column:
        pos, indent, pending = c["pos"], c["indent"], b["pending"]

        def new_state(*, scopes=b["scopes"], pending=pending, prefix=b["prefix"],
                      last_top=acc["last_top"], head=_null(_HEAD_TYPE)) -> Column:
            return _struct(delta_type, {
                "scopes": scopes, "pending": pending, "prefix": prefix, "last_top": last_top,
                "head": head})

        def unit(end: Column, **fields) -> Column:
            values = {n: fields.get(n, _null(t)) for n, t in _HEAD_FIELDS.items()}
            values |= {"start": pos, "end": end["end"], "cut": end["cut"]}
            return _struct(_HEAD_TYPE, values)

        unmatched = new_state(pending=F.when(c["cmt"] | c["dec"], pending).otherwise(
            _null(_PENDING_TYPE)))
        decorated = new_state(pending=_struct(_PENDING_TYPE, {
            "line": pos,
            "job": F.coalesce(pending["job"], F.lit(False)) | r["job"],
            "method": F.coalesce(r["method"], pending["method"]),
            "path": F.coalesce(r["path"], pending["path"])}))
        prefixed = new_state(prefix=F.coalesce(r["path"], F.lit("")))

        def with_end(end: Column) -> Column:
            method = F.coalesce(r["method"], F.lit("ANY"))
            path = F.coalesce(F.nullif(r["path"], F.lit("")), F.lit("/"))
            as_job = new_state(head=unit(end, type=F.lit("job"), name=r["name"]))
            as_route = new_state(head=unit(
                end, type=F.lit("endpoint"),
                name=F.coalesce(r["name"], F.concat(method, F.lit(" "), path)),
                method=method, path=path, handler=r["handler"], rest=r["rest"]))

            scope = _struct(_SCOPE_TYPE, {
                "name": r["name"], "indent": indent, "start": pos,
                "end": blocks.scope_end(lines, pos, end["end"], indent),
                "member": blocks.member_indent(lines, pos, end["end"], indent)})
            deeper = F.concat(b["scopes"], F.array(scope))
            as_scope = new_state(scopes=deeper)

            plain = F.when(inside & (r["type"] == "function"), F.lit("method")).otherwise(r["type"])
            is_job = ~r["container"] & F.coalesce(pending["job"], F.lit(False))
            is_endpoint = ~r["container"] & ~is_job & (
                pending["method"].isNotNull() | pending["path"].isNotNull())
            full_path = extras.join_path(b["prefix"], pending["path"])
            verb = F.coalesce(pending["method"], F.lit("ANY"))
            end_here = F.greatest(acc["last_top"], end["end"])
            as_def = new_state(
                head=unit(
                    end, is_def=F.lit(True), def_name=r["name"],
                    type=F.when(is_job, F.lit("job")).when(is_endpoint, F.lit("endpoint"))
                    .otherwise(plain),
                    name=F.when(is_endpoint, F.concat(verb, F.lit(" "), full_path)).otherwise(
                        r["name"]),
                    method=F.when(is_endpoint, verb), path=F.when(is_endpoint, full_path),
                    handler=F.when(is_endpoint, r["name"]),
                    parent=F.coalesce(r["parent"], F.when(inside, top["name"])),
                    kind=r["extra_kind"]),
                pending=_null(_PENDING_TYPE),
                prefix=F.when(r["container"], F.coalesce(pending["path"], b["prefix"])).otherwise(
                    b["prefix"]),
                scopes=F.when(r["container"], deeper).otherwise(b["scopes"]),
                last_top=F.when(inside, acc["last_top"]).otherwise(end_here),
            )
            return (
                F.when(r["kind"] == "job", as_job).when(r["kind"] == "route", as_route)
                .when(~r["unit"], as_scope).otherwise(as_def)
            )

        needs_end = bind(
            blocks.block_end(lines, brackets, pos, indent, F.col("_block"), limits.block_lines),
            with_end)
        return (
            F.when(r.isNull(), unmatched).when(r["kind"] == "prefix", prefixed)
            .when(r["kind"] == "decorator", decorated).otherwise(needs_end)
        )

    # ``aggregate`` copies its state at every step. Heads are therefore gathered in short
    # stretches, and stretches in longer ones, so that a file with very many units does not
    # copy all the heads found so far for every candidate.
    def fold(items: Column, acc: Column, sizes: list[int]) -> Column:
        if not sizes:
            return F.aggregate(items, acc, step)
        size = sizes[0]
        starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(size))
        stretches = F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(size)))

        def over(a: Column, stretch: Column) -> Column:
            fresh = _struct(state_type, {
                "scopes": a["scopes"], "pending": a["pending"], "prefix": a["prefix"],
                "last_top": a["last_top"], "out": no_heads})
            return bind_as(state_type, fold(stretch, fresh, sizes[1:]), lambda r: F.struct(
                r["scopes"].alias("scopes"), r["pending"].alias("pending"),
                r["prefix"].alias("prefix"), r["last_top"].alias("last_top"),
                F.concat(a["out"], r["out"]).alias("out")))

        return F.aggregate(stretches, acc, over)

    start = _struct(state_type, {
        "scopes": F.array().cast(f"array<{_SCOPE_TYPE}>"), "pending": _null(_PENDING_TYPE),
        "prefix": F.lit(""), "last_top": F.lit(-1), "out": no_heads})
    return fold(candidates, start, [256, 16])["out"]


def _comment_of(lines: Column, u: Column, limits: Limits) -> Column:
    pairs = F.col("_pairs")
    above = comments.comment_above(lines, u["start"], pairs, limits.comment_lines)
    below = F.when(F.col("_docstring") & u["is_def"], bind(
        comments.docstring_below(lines, u["start"], pairs, limits), lambda b: F.when(b != "", b)))
    return F.coalesce(below, above)


def _short(text: Column, limits: Limits) -> Column:
    return text if limits.comment_chars is None else F.substring(text, 1, limits.comment_chars)


@cache
def _mined(limits: Limits) -> Column:
    """struct(n_lines, header, units) of one file; units carry their comment and body, and whether
    a limit cut either.

    Over the columns that :func:`mine_files` puts beside the text. It depends on nothing
    else, so it is built once per process."""
    def with_lines(lines: Column) -> Column:
        brackets = F.when(F.col("_brace"), F.transform(
            lines, lambda m: blocks.bracket_counts(m["l"], F.col("_hash"))))

        def body(u: Column) -> Column:
            own = F.slice(lines, u["start"] + 1, u["end"] - u["start"] + 1)
            return F.array_join(F.transform(own, lambda m: m["l"]), "\n")

        def with_heads(heads: Column) -> Column:
            units = F.transform(heads, lambda u: bind(_comment_of(lines, u, limits), lambda c: F.struct(
                u.alias("u"), _short(c, limits).alias("comment"),
                (u["cut"] | (F.length(c) > lines_of(limits.comment_chars))).alias("cut"),
                body(u).alias("body"))))
            header = comments.file_header(lines, F.col("_pairs"), limits.comment_lines)
            return F.struct(
                F.size(lines).alias("n_lines"), _short(header, limits).alias("header"),
                units.alias("units"))

        return bind(brackets, lambda br: bind(unit_heads(lines, br, limits), with_heads))

    matched = F.expr(matches_sql("_lang", "_lines", "_ascii"))
    return bind(matched, lambda found: bind(
        line_array(F.col("_lines"), F.col("_lang"), found), with_lines))


def mine_files(files: DataFrame, areas: list[tuple[str, str]] = (),
               limits: Limits = Limits()) -> DataFrame:
    """files(repo, path, text[, lang]) -> one row per file with its mined units. Both the unit
    table and the file table come from it; save it when both are wanted. ``limits`` is how far
    blocks and comments reach; units that a limit cut say so."""
    lang = F.col("lang") if "lang" in files.columns else P.detect_lang(F.col("path"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return files.select(
        "repo", P.posix(F.col("path")).alias("file"),
        F.coalesce(lang, F.lit("")).alias("_lang"),
        P.area_of(F.col("path"), areas).alias("area"), text.alias("text"),
        split_lines(text).alias("_lines"),
        (F.octet_length(text) == F.length(text)).alias("_ascii"),
    ).select(
        "*", *[c.alias(n) for n, c in language_columns(F.col("_lang")).items()],
    ).select(
        "repo", "file", F.nullif("_lang", F.lit("")).alias("lang"), "area",
        _mined(limits).alias("mined"), file_routes(F.col("text"), limits).alias("routes"), "text",
    ).withColumn("text", F.when(F.size("mined.units") == 0, F.col("text")))


def file_stats(mined: DataFrame) -> DataFrame:
    """Lines, language, area, header and number of units of every file."""
    return mined.select(
        "repo", "file", F.col("mined.n_lines").alias("lines"), "lang", "area",
        F.col("mined.header").alias("header"),
        F.greatest(F.size("mined.units"), F.lit(1)).alias("n_units"))


# What :func:`mined_units` can carry beside a unit: facts about its file, on the first unit of
# the file, and the name under which it may stand in a route table.
FILE_FACTS = ["_lines", "_header", "_n_units", "_routes"]
FACTS = [*FILE_FACTS, "_component"]


def file_stats_of(units: DataFrame) -> DataFrame:
    """The file table from units mined ``with_facts``; every file has a first unit."""
    return units.where(F.col("_lines").isNotNull()).select(
        "repo", "file", F.col("_lines").alias("lines"), "lang", "area",
        F.col("_header").alias("header"), F.col("_n_units").alias("n_units"))


def route_table_of(units: DataFrame) -> DataFrame:
    """The route table from units mined ``with_facts``."""
    return first_routes(units.where(F.col("_routes").isNotNull()).select(
        "repo", "file", F.col("_routes").alias("routes")))


def _whole_file(mined: Column, text: Column, file: Column) -> Column:
    """The single unit of a file in which no rule found one."""
    head = {n: _null(t) for n, t in _HEAD_FIELDS.items()}
    head |= {"start": F.lit(0), "end": F.greatest(mined["n_lines"] - 1, F.lit(0)),
             "type": F.lit("file"), "name": F.substring_index(file, "/", -1)}
    return F.array(F.struct(
        _struct(_HEAD_TYPE, head).alias("u"), mined["header"].alias("comment"), F.lit(False).alias("cut"),
        F.regexp_replace(text, "\r\n", "\n").alias("body")))


def mined_units(mined: DataFrame, routes: DataFrame | None = None, *,
                with_facts: bool = False) -> DataFrame:
    """The unit table, one row per unit. ``routes`` turns components into pages.
    ``with_facts`` adds the columns of ``FACTS``, from which the file table and the route
    table can be taken without reading the source again."""
    m = F.col("mined")
    rows = mined.select(
        "repo", "file", "lang", "area",
        m["n_lines"].alias("_lines"), m["header"].alias("_header"),
        F.greatest(F.size(m["units"]), F.lit(1)).alias("_n_units"), F.col("routes").alias("_routes"),
        F.posexplode(F.when(F.size(m["units"]) > 0, m["units"]).otherwise(
            _whole_file(m, F.coalesce("text", F.lit("")), F.col("file")))).alias("_nth", "x"))
    u, body = F.col("x.u"), F.col("x.body")
    lang = F.coalesce(F.col("lang"), F.lit(""))
    jsx = by_language(lang, lambda s: s.jsx, False)
    component = (
        jsx & u["def_name"].rlike("^[A-Z]")
        & (((u["type"] == "function") & extras.has_jsx(body))
           | ((u["type"] == "class")
              & F.substring_index(body, "\n", 1).rlike(rx(extras.REACT_CLASS)))))
    found = extras.body_extras(body, lang)
    rest = F.when(u["rest"].isNotNull(), bind(extras.middleware(u["rest"]), null_if_empty))
    flat = rows.select(
        "repo", "file", "lang", "area", u.alias("u"), F.col("x.comment").alias("comment"),
        F.col("x.cut").alias("cut"), F.when(component, u["def_name"]).alias("_component"),
        *[c.alias(n) for n, c in found.items()],
        rest.alias("middleware"),
        *[F.when(F.col("_nth") == 0, F.col(c)).alias(c) for c in FILE_FACTS])
    u = F.col("u")
    extra = F.struct(
        u["method"].alias("method"), u["path"].alias("path"), u["handler"].alias("handler"),
        u["parent"].alias("parent"), u["kind"].alias("kind"), _null("string").alias("route"),
        "tables", "calls", "emits", "imports", "middleware").cast(EXTRA_TYPE)
    start = u["start"] + 1
    type_ = F.when(F.col("_component").isNotNull(), F.lit("component")).otherwise(u["type"])
    units = flat.select(
        "repo",
        F.concat(F.col("file"), F.lit(":"), start.cast("string"), F.lit(" "), u["name"]).alias("id"),
        "file", "lang", type_.alias("type"), u["name"].alias("name"),
        start.alias("start"), (u["end"] + 1).alias("end"),
        "comment", F.col("comment").alias("description"), "area", extra.alias("extra"), "cut",
        *FACTS)
    if routes is not None:
        units = with_pages(units, routes)
    return units if with_facts else units.drop(*FACTS)


def with_pages(units: DataFrame, routes: DataFrame, broadcast_limit: int = 200_000) -> DataFrame:
    """Components (units ``with_facts``) that a route names become pages. The route table is
    broadcast only when it is small; else both sides are shuffled, and units that are no
    component get keys of their own, spread over all tasks, since they match nothing."""
    named = routes.select("repo", F.col("component").alias("_key"), F.col("route").alias("_route"))
    keyed = units.withColumn("_key", F.col("_component"))
    if named.limit(broadcast_limit + 1).count() <= broadcast_limit:
        named = F.broadcast(named)
    else:
        spread = F.concat(F.lit("\u0000"), F.xxhash64("file", "start").cast("string"))
        keyed = keyed.withColumn("_key", F.coalesce("_component", spread))
    is_page = F.col("_route").isNotNull()
    paged = {
        "type": F.when(is_page, F.lit("page")).otherwise(F.col("type")),
        "extra": F.when(is_page, F.col("extra").withField("route", F.col("_route"))).otherwise(
            F.col("extra")),
    }
    return keyed.join(named, ["repo", "_key"], "left").select(*[
        paged[c].alias(c) if c in paged else F.col(c) for c in units.columns])


def unit_source(text: Column, start: Column, end: Column, cap: int = 60) -> Column:
    """Source of a unit (1-based lines), at most ``cap`` lines, with a mark when cut."""
    lines = F.split(text, "\n", -1)

    def of(all_lines: Column) -> Column:
        first = F.greatest(F.lit(1), F.coalesce(F.nullif(start, F.lit(0)), F.lit(1)))
        wanted = F.coalesce(F.nullif(end, F.lit(0)), first)
        last = F.least(F.size(all_lines), F.greatest(first, wanted), first + (cap - 1))
        body = F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
        return F.concat(body, F.when(wanted > last, F.lit("\n// ... (truncated)")).otherwise(
            F.lit("")))

    return bind(lines, of)

