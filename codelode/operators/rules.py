"""Rule catalogue: which lines start a unit, per language.

Rules are tried in list order and the first one that applies to a line wins. A rule
becomes literal regular expressions inside one generated expression
(:func:`matches`), so patterns are compiled once per task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from codelode.functions.regex import rx

Groups = Callable[[int], str]


def sql_text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Rule:
    """``kind``: def, route, decorator, prefix or job. ``name``, ``method`` and
    ``path`` are a group number, a fixed string, or a function of the groups."""

    kind: str
    pattern: str
    name: int | str | Callable[[Groups], str] | None = None
    method: int | str | Callable[[Groups], str] | None = None
    path: int | None = None
    path_given: str | None = None  # pattern that tells an empty path from an absent one
    rest: int | None = None
    handler: int | None = None
    parent: int | None = None
    type: str | None = None
    extra_kind: str | Callable[[Groups], str] | None = None
    container: bool = False
    inside_only: bool = False
    unit: bool = True
    job: bool = False
    not_names: tuple[str, ...] = ()
    ignore_case: bool = False

    def java(self, ascii_only: bool) -> str:
        return ("(?i)" if self.ignore_case else "") + rx(self.pattern, ascii_only=ascii_only)


@dataclass(frozen=True)
class Language:
    rules: list[Rule]
    line_comments: list[str]
    block_comments: list[tuple[str, str]]
    decorator: str | None = None
    block: str = "brace"
    max_indent: int = 0
    docstring: bool = False
    jsx: bool = False
    imports: bool = False
    sql: bool = True
    extensions: list[str] = field(default_factory=list)


def function(pattern: str, name, **kw) -> Rule:
    return Rule("def", pattern, name=name, type=kw.pop("type", "function"), **kw)


def klass(pattern: str, name, **kw) -> Rule:
    return Rule("def", pattern, name=name, type="class", **kw)


def scope(pattern: str, name: int) -> Rule:
    return Rule("def", pattern, name=name, container=True, unit=False)


def route(pattern: str, path: int, method, **kw) -> Rule:
    return Rule("route", pattern, path=path, method=method, **kw)


def decorator(pattern: str, **kw) -> Rule:
    return Rule("decorator", pattern, **kw)


def job(pattern: str, title: str) -> Rule:
    return Rule("job", pattern, name=lambda g: f"concat('{title}', {g(1)})")


def _listed_methods(g: Groups) -> str:
    """Methods of a Flask route: GET,POST from ``'GET', "post"``; GET when not given."""
    bare = f"regexp_replace({g(3)}, {sql_text(rx(QUOTE_OR_SPACE))}, '')"
    names = f"upper(array_join(filter(split({bare}, ','), m -> m != ''), ','))"
    return f"if({g(3)} = '', 'GET', {names})"


def _spring_method(g: Groups) -> str:
    return f"if({g(2)} = 'Request', 'ANY', upper({g(2)}))"


def _impl_name(g: Groups) -> str:
    return f"if({g(2)} != '', concat('impl ', {g(2)}, ' for ', {g(3)}), concat('impl ', {g(3)}))"


def _sql_name(g: Groups) -> str:
    return f"concat(lower({g(2)}), ' ', {g(3)})"


def _sql_kind(g: Groups) -> str:
    return f"lower({g(2)})"


# The patterns, settings and file extensions below decide which units
# exist, so they must stay as they are, in this order.
QUOTE_OR_SPACE = r"""['"\s]"""
HTTP = "get|post|put|delete|patch|all|options|head"
ID = r"[A-Za-z_$][\w$]*"

JS_ROUTES = [
    route(
        r"^(\s*)(?:[\w$]+\.)*(?:\w*[Rr]outer|app|server|fastify|api|routes)\.(" + HTTP
        + r""")\(\s*['"`]([^'"`]+)['"`]\s*(.*)$""", path=3, method=2, rest=4),
    Rule("prefix", r"""^(\s*)@Controller\(\s*(?:['"`]([^'"`]*)['"`])?\s*\)""", path=2),
    decorator(
        r"""^(\s*)@(Get|Post|Put|Delete|Patch|All|Head|Options)\(\s*(?:['"`]([^'"`]*)['"`])?[^)]*\)""",
        method=2, path=3, path_given=r"""^\s*@\w+\(\s*['"`][^'"`]*['"`]"""),
    decorator(r"^(\s*)@Cron\(", job=True),
]
JS_DEFS = [
    function(r"^(\s*)(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(" + ID
             + r")\s*(?:<[^>]*>)?\s*\(", 2),
    function(r"^(\s*)export\s+default\s+(?:async\s+)?function\s*\*?\s*\(", "default"),
    function(r"^(\s*)(?:export\s+(?:default\s+)?)?(?:const|let|var)\s+(" + ID
             + r")\s*(?::\s*[^=]+?)?\s*=\s*(?:(?:React\.)?(?:memo|forwardRef|observer)\(\s*)?"
             r"(?:async\s*)?(?:function\b|(?:\([^)]*\)|" + ID + r")\s*(?::\s*[^=]+?)?=>)", 2),
    klass(r"^(\s*)(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(" + ID + r")", 2,
          container=True),
]
TS_DEFS = [
    klass(r"^(\s*)(?:export\s+(?:default\s+)?)?interface\s+(" + ID + r")", 2,
          extra_kind="interface"),
    klass(r"^(\s*)(?:export\s+(?:default\s+)?)?(?:const\s+)?enum\s+(" + ID + r")", 2,
          extra_kind="enum"),
]
JS_MEMBERS = [
    function(
        r"^(\s*)(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set"
        r"|declare)\s+)*\*?\s*(#?" + ID + r")\s*(?:<[^>]*>)?\s*\(", 2, inside_only=True,
        not_names=("if", "for", "while", "switch", "catch", "return", "new", "typeof", "await",
                   "super", "else", "function", "do", "import", "require")),
    function(
        r"^(\s*)(?:(?:public|private|protected|static|readonly|override)\s+)*(#?" + ID
        + r")\s*(?::\s*[^=]+?)?\s*=\s*(?:async\s*)?(?:\([^)]*\)|" + ID
        + r")\s*(?::\s*[^=]+?)?=>", 2, inside_only=True),
    job(r"""\bcron\.schedule\(\s*['"`]([^'"`]+)['"`]""", "cron "),
    job(r"""\bnew\s+CronJob\(\s*['"`]([^'"`]+)['"`]""", "cron "),
    job(r"""\bschedule\.scheduleJob\(\s*['"`]([^'"`]+)['"`]""", "cron "),
    job(r"\bsetInterval\(\s*(" + ID + r")\s*,", "interval "),
]
PY_RULES = [
    decorator(
        r"""^(\s*)@[\w.]+\.route\(\s*['"]([^'"]+)['"](?:.*?methods\s*=\s*[[(]([^\])]*)[\])])?""",
        path=2, method=_listed_methods),
    decorator(
        r"""^(\s*)@[\w.]+\.(get|post|put|delete|patch|head|options|websocket)\(\s*['"]([^'"]+)['"]""",
        method=2, path=3),
    decorator(r"""^(\s*)@[\w.]+\.api_route\(\s*['"]([^'"]+)['"]""", path=2, method="ANY"),
    decorator(
        r"^(\s*)@(?:[\w.]+\.)?(?:task|shared_task|periodic_task|cron|scheduled_job|job|repeat_every)\b",
        job=True),
    route(r"""^(\s*)(?:re_)?path\(\s*r?['"]([^'"]*)['"]\s*,\s*([\w.]+)""", path=2, method="ANY",
          handler=3),
    function(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(", 2),
    klass(r"^(\s*)class\s+(\w+)", 2, container=True),
]
GO_RULES = [
    route(r"""^(\s*)[\w.]+\.(?:HandleFunc|Handle)\(\s*"([^"]+)\"""", path=2, method="ANY"),
    route(r"^(\s*)[\w.]+\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch|Head"
          r"""|Options)\(\s*"([^"]+)\"""", path=3, method=2),
    function(r"^(\s*)func\s*\(\s*\w+\s+\*?(\w+)(?:\[[^\]]*\])?\s*\)\s+(\w+)\s*\(", 3,
             type="method", parent=2),
    function(r"^(\s*)func\s+(\w+)\s*[([]", 2),
    klass(r"^(\s*)type\s+(\w+)\s+(?:struct|interface)\b", 2),
]
RS_RULES = [
    decorator(r"""^(\s*)#\[(get|post|put|delete|patch|head|options)\(\s*"([^"]+)\"""",
              method=2, path=3),
    route(r"""^(\s*)\.route\(\s*"([^"]+)"\s*,\s*(get|post|put|delete|patch)\(""", path=2, method=3),
    function(r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?"
             r"""(?:extern\s+"[^"]*"\s+)?fn\s+(\w+)""", 2),
    klass(r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", 2, container=True,
          extra_kind="trait"),
    klass(r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(struct|enum|union)\s+(\w+)", 3),
    klass(r"^(\s*)(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(\w+)(?:<[^>]*>)?\s+for\s+)?(\w+)",
          _impl_name, container=True, extra_kind="impl"),
    scope(r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{", 2),
]
JAVA_MODS = (
    r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp"
    r"|sealed|non-sealed|transient|volatile)\s+)*")
JAVA_NOT = (
    r"(?!(?:return|new|else|throw|if|for|while|switch|catch|case|do|try|super|this|import|package"
    r"|assert|break|continue)\b)")
JAVA_RULES = [
    decorator(
        r"^(\s*)@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"
        r"""['"]([^'"]*)['"]""", method=_spring_method, path=3),
    decorator(r"^(\s*)@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*$", method=2),
    decorator(r"""^(\s*)@Path\(\s*['"]([^'"]*)['"]""", path=2),
    decorator(r"^(\s*)@Scheduled\(", job=True),
    klass(r"^(\s*)" + JAVA_MODS + r"(class|interface|enum|record|@interface)\s+(\w+)", 3,
          container=True),
    function(r"^(\s*)" + JAVA_MODS + r"(?:<[^>]+>\s+)?" + JAVA_NOT + r"[\w<>\[\],?.]+\s+(\w+)\s*"
             r"\([^)]*\)?\s*(?:throws\s+[\w.,\s]+)?\s*(?:\{|$|;)", 2, inside_only=True),
]
KOTLIN_RULES = [
    decorator(
        r"^(\s*)@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\[?"
        r"""['"]([^'"]*)['"]""", method=_spring_method, path=3),
    decorator(r"^(\s*)@Scheduled\(", job=True),
    route(r"""^(\s*)(get|post|put|delete|patch|head|options)\(\s*"([^"]+)"\s*\)\s*\{""",
          path=3, method=2),
    klass(r"^(\s*)(?:(?:public|private|protected|internal|abstract|open|final|sealed|data|enum"
          r"|annotation|inner|value|companion)\s+)*(class|interface|object)\s+(\w+)", 3,
          container=True),
    function(r"^(\s*)(?:(?:public|private|protected|internal|override|open|abstract|suspend|inline"
             r"|operator|infix|tailrec|external|actual|expect)\s+)*fun\s+(?:<[^>]*>\s+)?"
             r"(?:[\w.<>?]+\.)?(\w+)\s*\(", 2),
]
CS_MODS = (
    r"(?:(?:public|private|protected|internal|static|abstract|sealed|virtual|override|async|partial"
    r"|extern|unsafe|new|readonly)\s+)*")
CS_NOT = (
    r"(?!(?:return|new|else|throw|if|for|foreach|while|switch|catch|case|do|try|using|lock|await"
    r"|yield|var|get|set|add|remove|base|this|namespace)\b)")
CS_RULES = [
    decorator(r"""^(\s*)\[Http(Get|Post|Put|Delete|Patch|Head|Options)\(\s*"([^"]+)"\s*\)\]""",
              method=2, path=3),
    decorator(r"^(\s*)\[Http(Get|Post|Put|Delete|Patch|Head|Options)\]", method=2),
    decorator(r"""^(\s*)\[Route\(\s*"([^"]+)"\s*\)\]""", path=2),
    route(r"""^(\s*)[\w.]+\.Map(Get|Post|Put|Delete|Patch)\(\s*"([^"]+)\"""", path=3, method=2),
    scope(r"^(\s*)namespace\s+([\w.]+)\s*\{?\s*$", 2),
    klass(r"^(\s*)" + CS_MODS + r"(?:(?:readonly|ref)\s+)?(class|interface|struct|enum"
          r"|record(?:\s+struct|\s+class)?)\s+(\w+)", 3, container=True),
    function(r"^(\s*)" + CS_MODS + CS_NOT + r"[\w<>\[\],?.]+\s+(\w+)\s*\([^)]*\)?\s*"
             r"(?:where\s+[^{]+)?(?:\{|$|;|=>)", 2, inside_only=True),
]
SWIFT_RULES = [
    route(r"""^(\s*)[\w.]+\.(get|post|put|delete|patch)\(\s*"([^"]+)\"""", path=3, method=2),
    klass(r"^(\s*)(?:(?:public|private|internal|fileprivate|open|final|indirect)\s+)*"
          r"(class|struct|enum|protocol|extension|actor)\s+([\w.]+)", 3, container=True),
    function(r"^(\s*)(?:(?:public|private|internal|fileprivate|open|static|class|override|mutating"
             r"|final|convenience|required|@objc|@discardableResult|@MainActor|nonisolated)\s+)*"
             r"func\s+(\w+)", 2),
    function(r"^(\s*)(?:(?:public|private|internal|fileprivate|required|convenience|override)\s+)*"
             r"(init)\s*[(?!]", 2, inside_only=True),
]
RUBY_RULES = [
    route(r"""^(\s*)(get|post|put|patch|delete)\s+['"]([^'"]+)['"]""", path=3, method=2),
    route(r"^(\s*)(resources?)\s+:(\w+)", path=3, method="RESOURCE",
          name=lambda g: f"concat('RESOURCE /', {g(3)})"),
    function(r"^(\s*)def\s+(?:self\.)?([\w?!=]+)", 2),
    klass(r"^(\s*)(class|module)\s+([\w:]+)", 3, container=True),
]
PHP_RULES = [
    route(r"""^(\s*)Route::(get|post|put|patch|delete|any|match)\(\s*['"]([^'"]+)['"]""",
          path=3, method=2),
    route(r"""^(\s*)\$(?:app|router|r|group)->(get|post|put|patch|delete|any)\(\s*['"]([^'"]+)['"]""",
          path=3, method=2),
    function(r"^(\s*)(?:(?:public|private|protected|static|abstract|final)\s+)*"
             r"function\s+&?(\w+)\s*\(", 2),
    klass(r"^(\s*)(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+(\w+)", 3,
          container=True),
]
SH_RULES = [
    function(r"^(\s*)(?:function\s+)?([\w.:-]+)\s*\(\s*\)\s*\{?", 2),
    function(r"^(\s*)function\s+([\w.:-]+)\b", 2),
]
SQL_RULES = [
    klass(r"^(\s*)CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|UNLOGGED|MATERIALIZED)\s+)*"
          r"""(TABLE|VIEW|TYPE)\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"[]?([\w.]+)""", _sql_name,
          extra_kind=_sql_kind, ignore_case=True),
    function(r"^(\s*)CREATE\s+(?:OR\s+REPLACE\s+)?(?:DEFINER\s*=\s*\S+\s+)?"
             r"""(PROCEDURE|FUNCTION|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"[]?([\w.]+)""", _sql_name,
             extra_kind=_sql_kind, ignore_case=True),
]

C_BLOCK = [("/*", "*/")]
AT = r"^\s*@\w"
HASH_BRACKET = r"^\s*#\["
LANGUAGES: dict[str, Language] = {
    "js": Language(JS_ROUTES + JS_DEFS + JS_MEMBERS, ["//"], C_BLOCK, AT, max_indent=2, jsx=True,
                   imports=True, extensions=["js", "jsx", "mjs", "cjs"]),
    "ts": Language(JS_ROUTES + JS_DEFS + TS_DEFS + JS_MEMBERS, ["//"], C_BLOCK, AT, max_indent=2,
                   jsx=True, imports=True, extensions=["ts", "tsx", "mts", "cts"]),
    "py": Language(PY_RULES, ["#"], [('"""', '"""'), ("'''", "'''")], AT, block="indent",
                   docstring=True, extensions=["py", "pyw"]),
    "go": Language(GO_RULES, ["//"], C_BLOCK, extensions=["go"]),
    "rs": Language(RS_RULES, ["//"], C_BLOCK, HASH_BRACKET, extensions=["rs"]),
    "java": Language(JAVA_RULES, ["//"], C_BLOCK, AT, extensions=["java"]),
    "kotlin": Language(KOTLIN_RULES, ["//"], C_BLOCK, AT, extensions=["kt", "kts"]),
    "csharp": Language(CS_RULES, ["//"], C_BLOCK, r"^\s*\[\w", extensions=["cs"]),
    "swift": Language(SWIFT_RULES, ["//"], C_BLOCK, AT, extensions=["swift"]),
    "ruby": Language(RUBY_RULES, ["#"], [("=begin", "=end")], block="end",
                     extensions=["rb", "rake"]),
    "php": Language(PHP_RULES, ["//", "#"], C_BLOCK, HASH_BRACKET, max_indent=4,
                    extensions=["php"]),
    "sh": Language(SH_RULES, ["#"], [], extensions=["sh", "bash", "zsh"]),
    "sql": Language(SQL_RULES, ["--"], C_BLOCK, block="semicolon", extensions=["sql"]),
}
# Files of no known language that were included on purpose.
GENERIC = Language([], ["//", "#", "--"], C_BLOCK + [('"""', '"""'), ("<!--", "-->")], sql=False)
# Fixed values end.

EXTENSIONS = {ext: lang for lang, spec in LANGUAGES.items() for ext in spec.extensions}

MATCH_TYPE = (
    "array<struct<kind:string,name:string,method:string,path:string,rest:string,handler:string,"
    "parent:string,type:string,extra_kind:string,container:boolean,inside_only:boolean,"
    "unit:boolean,job:boolean,allowed:boolean>>"
)


def by_language(lang: Column, value: Callable[[Language], object], default: object) -> Column:
    """Literal (or Column) per language; ``default`` for the rest. Languages with the
    same value share one branch."""
    branches: list[tuple[object, list[str]]] = []
    for name, spec in LANGUAGES.items():
        v = value(spec)
        if isinstance(v, (str, int, bool)) and v == default:
            continue
        for known, names in branches:
            if not isinstance(v, Column) and known == v:
                names.append(name)
                break
        else:
            branches.append((v, [name]))
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    if not branches:
        return as_col(default)
    chain = reduce(
        lambda acc, b: acc.when(lang.isin(b[1]), as_col(b[0])), branches[1:],
        F.when(lang.isin(branches[0][1]), as_col(branches[0][0])),
    )
    return chain.otherwise(as_col(default))


def language_columns(lang: Column) -> dict[str, Column]:
    """Settings of the language of a file as columns, worked out once per file."""
    pairs_type = "array<struct<open:string,close:string>>"

    def pairs(spec: Language) -> Column:
        found = [F.struct(F.lit(o).alias("open"), F.lit(c).alias("close"))
                 for o, c in spec.block_comments]
        return (F.array(*found) if found else F.array()).cast(pairs_type)

    def starts_comment(prefix: str) -> Column:
        return by_language(lang, lambda s: prefix in s.line_comments,
                           prefix in GENERIC.line_comments)

    pair_lists = {str(s.block_comments): s for s in LANGUAGES.values()}
    by_list = by_language(lang, lambda s: str(s.block_comments), str(GENERIC.block_comments))
    chosen = F.when(by_list == str(GENERIC.block_comments), pairs(GENERIC))
    for key, spec in pair_lists.items():
        chosen = chosen.when(by_list == key, pairs(spec))
    return {
        "_block": by_language(lang, lambda s: s.block, "brace"),
        "_max_indent": by_language(lang, lambda s: s.max_indent, 0),
        "_docstring": by_language(lang, lambda s: s.docstring, False),
        "_brace": by_language(lang, lambda s: s.block == "brace", False),
        "_slash": starts_comment("//"), "_hash": starts_comment("#"), "_dash": starts_comment("--"),
        "_pairs": chosen,
    }


def _match_sql(rule: Rule, line: str, ascii_only: bool) -> str:
    """What the rule captures on the line, NULL when it does not match."""
    pattern = sql_text(rule.java(ascii_only))

    def group(n: int) -> str:
        return f"regexp_extract({line}, {pattern}, {n})"

    def text(value) -> str:
        if value is None:
            return "CAST(NULL AS string)"
        if isinstance(value, int):
            return group(value)
        return sql_text(value) if isinstance(value, str) else value(group)

    def present(value) -> str:
        return text(value) if value is None else f"nullif({text(value)}, '')"

    method = f"upper({text(rule.method)})" if isinstance(rule.method, int) else text(rule.method)
    path = text(rule.path)
    if rule.path_given:
        path = f"if({line} rlike {sql_text(rx(rule.path_given))}, {path}, NULL)"
    allowed = "true"
    if rule.not_names:
        names = ", ".join(sql_text(n) for n in rule.not_names)
        allowed = f"{text(rule.name)} NOT IN ({names})"
    fields = {
        "kind": sql_text(rule.kind), "name": text(rule.name),
        "method": method if rule.method is None else f"nullif({method}, '')",
        "path": path, "rest": text(rule.rest), "handler": present(rule.handler),
        "parent": present(rule.parent), "type": text(rule.type),
        "extra_kind": text(rule.extra_kind), "container": str(rule.container).lower(),
        "inside_only": str(rule.inside_only).lower(), "unit": str(rule.unit).lower(),
        "job": str(rule.job).lower(), "allowed": allowed,
    }
    struct = ", ".join(f"'{n}', {v}" for n, v in fields.items())
    return f"CASE WHEN {line} rlike {pattern} THEN named_struct({struct}) END"


def any_rule(spec: Language, ascii_only: bool) -> str:
    """A pattern that matches where one of the rules of the language does."""
    return "|".join(("(?i:" if r.ignore_case else "(?:") + rx(r.pattern, ascii_only=ascii_only) + ")"
                    for r in spec.rules)


def matches_sql(lang: str, lines: str, is_ascii: str) -> str:
    """SQL expression: for every line of the array column ``lines``, the rules of the
    language that match it, in rule order; NULL for lines without any and unknown languages.
    Files of ASCII text, nearly all of them, use the faster form of the patterns."""
    def of(spec: Language, ascii_only: bool) -> str:
        found = ", ".join(_match_sql(r, "l", ascii_only) for r in spec.rules)
        return f"CAST(filter(array({found}), r -> r IS NOT NULL) AS {MATCH_TYPE})"

    # One search tells most lines, those that no rule matches, from the others.
    def branch(name: str, ascii_only: bool) -> str:
        test = f"l rlike {sql_text(any_rule(LANGUAGES[name], ascii_only))}"
        return (f"WHEN '{name}' THEN transform({lines}, "
                f"l -> if({test}, {of(LANGUAGES[name], ascii_only)}, NULL))")

    fast, full = (" ".join(branch(n, a) for n in LANGUAGES) for a in (True, False))
    return f"CASE WHEN {is_ascii} THEN CASE {lang} {fast} END ELSE CASE {lang} {full} END END"
