"""SQL fragments that the checks share: tokens and stems, written for DuckDB."""

from __future__ import annotations

from codelode.functions.text import STOP_WORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens(text: str) -> str:
    """List of tokens of a text expression."""
    spaced = f"regexp_replace(strip_accents({text}), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    words = f"regexp_split_to_array(lower({spaced}), '[^a-z0-9]+')"
    return f"[w FOR w IN {words} IF length(w) > 2 AND NOT list_contains({_STOP}, w)]"


def stem_ctes(vocab: str, name: str = "stems") -> str:
    """CTEs ending in ``name``(word, stem) for a CTE ``vocab``(word)."""
    tail = "(?:azion|ament|atur|ion|ent|at|ut|it|al|ar|er|ir)"
    steps = [
        "regexp_replace(s, '^(.{2,})ies$', '\\1y')",
        "CASE WHEN regexp_matches(s, '(ss|us|is)$') THEN s ELSE "
        "regexp_replace(s, '^(?:(.{3,})ers|(.{3,})es|(.{3,})s)$', '\\1\\2\\3') END",
        "regexp_replace(s, '^(.{3,})(?:ing|ed|tion)$', '\\1')",
        "regexp_replace(s, '^(.{3,})[aeio]$', '\\1')",
        f"CASE WHEN regexp_matches(s, '^.{{0,2}}{tail}$') THEN s ELSE "
        f"regexp_replace(s, '^(.{{3,}}?){tail}$', '\\1') END",
    ]
    ctes, previous, n = [], f"(SELECT word, word AS s FROM {vocab})", 0
    for _ in range(4):
        for step in steps:
            n += 1
            ctes.append(f"{name}_{n} AS (SELECT word, {step} AS s FROM {previous})")
            previous = f"{name}_{n}"
    ctes.append(f"{name} AS (SELECT word, s AS stem FROM {previous})")
    return ",\n".join(ctes)


def split_ctes(source: str, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}parts``(id, part_no, part): the parts of the texts of
    ``source`` (a query for id and text)."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def words(x: str) -> str:
        return f"len([w FOR w IN regexp_split_to_array(trim({x}, {blank}), '\\s+') IF w <> ''])"

    separators = "\\n+|\\s*[;•]\\s*|(?:^|\\s)[-*]\\s+|\\s+\\d+[.)]\\s+|\\s+\\+\\s+"
    connectors = (
        "(?i)\\s+e\\s+poi\\s+|\\s+poi\\s+|\\s+inoltre\\s+|\\s+and\\s+then\\s+|\\s+then\\s+"
        "|\\s+also\\s+|\\s+plus\\s+"
    )
    return f"""{prefix}src AS (SELECT id, trim(coalesce(text, ''), {blank}) AS whole FROM ({source})),
{prefix}clean AS (SELECT id, whole, regexp_replace(regexp_replace(whole,
  '(?i)^\\s*(feat|fix|chore|refactor|docs|style|perf|test|build|ci)(\\([^)]*\\))?!?:\\s*', ''),
  '\\b(BE|FE|Backend|Frontend|Fix|Refactor)\\s*:', chr(10), 'g') AS t FROM {prefix}src),
{prefix}clauses AS (SELECT id, whole, flatten([regexp_split_to_array(x, '{connectors}') FOR x IN regexp_split_to_array(t, '{separators}')]) AS cs FROM {prefix}clean),
{prefix}pieces AS (SELECT id, whole, flatten([
  CASE WHEN len(regexp_split_to_array(c, '\\s*,\\s*')) > 1 AND len([y FOR y IN regexp_split_to_array(c, '\\s*,\\s*') IF {words("y")} < 2]) = 0
   THEN regexp_split_to_array(c, '\\s*,\\s*') ELSE [c] END FOR c IN cs]) AS ps FROM {prefix}clauses),
{prefix}rows AS (SELECT id, i, p FROM (
  SELECT id, generate_subscripts(ps, 1) AS i, regexp_replace(regexp_replace(unnest(ps), '^[\\s:,;\\-–—]+', ''), '[\\s.:,;]+$', '') AS p FROM {prefix}pieces)
  WHERE length(p) >= 8 AND len({tokens("p")}) >= 1),
{prefix}firsts AS (SELECT id, min(i) AS i, min_by(p, i) AS p FROM {prefix}rows GROUP BY id, lower(p)),
{prefix}numbered AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) AS part_no, count(*) OVER (PARTITION BY id) AS n FROM {prefix}firsts),
{prefix}parts AS (
  SELECT id, part_no, trim(p, {blank}) AS part FROM {prefix}numbered WHERE n > 1
  UNION ALL SELECT id, 1, whole FROM {prefix}src WHERE whole <> '' AND id NOT IN (SELECT id FROM {prefix}numbered WHERE n > 1))"""
