"""DuckDB SQL that finds the units of the derived codebase from its text.

It reads the lines on its own: running bracket sums, range joins for block ends and
comments, joins for scopes. It knows the four languages of that codebase only.
"""

from __future__ import annotations

from codelode.operators.extras import TABLE_STOP_WORDS
from codelode.queries.codebase import CODE_FILES_SQL
from codelode.sources.corpus import DEFAULT_EXCLUDES

_NAMES = ", ".join(f"'{p}'" for p in DEFAULT_EXCLUDES if "*" not in p)
_ENDS = "|".join(p[1:].replace(".", r"\.") for p in DEFAULT_EXCLUDES if p.startswith("*"))
_STOP = ", ".join(f"'{w}'" for w in TABLE_STOP_WORDS)

FILES = f"""
files AS ({CODE_FILES_SQL}),
spoken AS (
  SELECT *, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1))
    WHEN 'py' THEN 'py' WHEN 'js' THEN 'js' WHEN 'rb' THEN 'ruby' WHEN 'sql' THEN 'sql' END AS lang
  FROM files
),
listed AS (
  SELECT * FROM spoken
  WHERE lang IS NOT NULL AND size <= 1048576
    AND len(list_intersect(string_split(path, '/'), [{_NAMES}])) = 0
    AND NOT regexp_matches(path, '(?:{_ENDS})(?:/|$)')
),
chosen AS (
  SELECT * FROM listed
  WHERE NOT (list_max([length(x) FOR x IN string_split(text, chr(10))]) > 2000
    OR (length(text) - length(replace(text, chr(10), '')) + 1) * 300
       < length(text) - (length(text) - length(replace(text, chr(10), ''))))
)"""

COMMENT_TEXT = (
    "left(trim(regexp_replace(array_to_string([x FOR x IN {parts} IF x <> '' AND NOT "
    "regexp_matches(x, '^[\\s=\\-*#/~_+|:.]*$') AND NOT regexp_matches(x, '^(@\\w|eslint-|noqa)')], "
    "' '), '\\s+', ' ', 'g')), 240)"
)


def _joined(parts: str) -> str:
    return COMMENT_TEXT.format(parts=parts)


UNITS = f"""
{FILES},
arrays AS (SELECT repo, path, lang, regexp_split_to_array(text, '\\r?\\n') AS ls FROM chosen),
raw_lines AS (
  SELECT repo, path, lang, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
  FROM arrays
),
lines AS (
  SELECT *, trim(line, ' ' || chr(9)) AS t, length(line) - length(ltrim(line, ' ' || chr(9))) AS ind,
    regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"', '""', 'g'),
      '''[^'']*''', '""', 'g'), '`[^`]*`', '""', 'g') AS quoteless
  FROM raw_lines
),
feats AS (
  SELECT *,
    CASE lang WHEN 'sql' THEN regexp_replace(quoteless, '--.*$', '') ELSE regexp_replace(quoteless, '//.*$', '') END AS code,
    CASE lang WHEN 'js' THEN t LIKE '//%' WHEN 'sql' THEN t LIKE '--%' ELSE t LIKE '#%' END AS cmt,
    lang IN ('py', 'js') AND regexp_matches(line, '^\\s*@\\w') AS dec
  FROM lines
),
sums AS (
  SELECT *, trim(code) AS tcode,
    length(code) - length(regexp_replace(code, '[({{\\[]', '', 'g')) AS opens,
    length(code) - length(regexp_replace(code, '[)}}\\]]', '', 'g')) AS closes
  FROM feats
),
depths AS (
  SELECT *, sum(opens - closes) OVER w AS net_to, sum(opens) OVER w AS opens_to
  FROM sums WINDOW w AS (PARTITION BY repo, path ORDER BY pos)
),
found AS (
  SELECT *, CASE lang
    WHEN 'py' THEN CASE
      WHEN regexp_matches(line, '^\\s*@[\\w.]+\\.(?:route|get|post|put|delete|patch)\\(\\s*[''"]') THEN 'decorator'
      WHEN regexp_matches(line, '^\\s*@(?:[\\w.]+\\.)?(?:task|shared_task|cron|job)\\b') THEN 'jobmark'
      WHEN regexp_matches(line, '^\\s*(?:async\\s+)?def\\s+\\w+\\s*\\(') THEN 'def'
      WHEN regexp_matches(line, '^\\s*class\\s+\\w+') THEN 'class' END
    WHEN 'js' THEN CASE
      WHEN regexp_matches(line, '^\\s*(?:app|router)\\.(?:get|post|put|delete)\\(\\s*[''"`][^''"`]+[''"`]') THEN 'route'
      WHEN regexp_matches(line, '^\\s*(?:export\\s+)?(?:async\\s+)?function\\s+\\w+\\s*\\(') THEN 'def'
      WHEN regexp_matches(line, '^\\s*(?:export\\s+)?(?:const|let|var)\\s+\\w+\\s*=\\s*(?:async\\s*)?\\([^)]*\\)\\s*=>') THEN 'def'
      WHEN regexp_matches(line, '^\\s*(?:export\\s+)?class\\s+\\w+') THEN 'class'
      WHEN regexp_matches(line, '^\\s*(?:async\\s+)?\\w+\\s*\\(') AND NOT regexp_matches(t, '^(?:if|for|while|return)\\b') THEN 'member'
      WHEN regexp_matches(line, '^\\s*\\w+\\s*=\\s*(?:async\\s*)?\\([^)]*\\)\\s*=>') THEN 'member'
      WHEN regexp_matches(line, '\\bcron\\.schedule\\(\\s*[''"`][^''"`]+[''"`]') THEN 'job' END
    WHEN 'ruby' THEN CASE
      WHEN regexp_matches(line, '^\\s*(?:get|post)\\s+[''"][^''"]+[''"]') THEN 'route'
      WHEN regexp_matches(line, '^\\s*def\\s+') THEN 'def'
      WHEN regexp_matches(line, '^\\s*class\\s+') THEN 'class' END
    WHEN 'sql' THEN CASE
      WHEN regexp_matches(line, '(?i)^\\s*create\\s+(?:or\\s+replace\\s+)?(?:table|view)\\s') THEN 'class' END
    END AS rule
  FROM depths
),
named AS (
  SELECT *, CASE
    WHEN lang = 'sql' THEN lower(regexp_extract(line, '(?i)(table|view)\\s', 1)) || ' ' || regexp_extract(line, '(?i)(?:table|view)\\s+(?:if\\s+not\\s+exists\\s+)?([\\w.]+)', 1)
    WHEN rule = 'class' THEN regexp_extract(line, 'class\\s+(\\w+)', 1)
    WHEN lang = 'ruby' THEN regexp_extract(line, 'def\\s+(?:self\\.)?([\\w?!=]+)', 1)
    WHEN lang = 'py' THEN regexp_extract(line, 'def\\s+(\\w+)', 1)
    WHEN rule = 'member' THEN regexp_extract(line, '^\\s*(?:async\\s+)?(\\w+)', 1)
    ELSE regexp_extract(line, '(?:function|const|let|var)\\s+(\\w+)', 1) END AS name
  FROM found WHERE rule IS NOT NULL
),
next_lines AS (
  SELECT c.repo, c.path, c.pos, min(l.pos) AS next_pos, min_by(l.t, l.pos) AS next_t
  FROM named c JOIN lines l ON l.repo = c.repo AND l.path = c.path AND l.pos > c.pos AND l.t <> ''
  GROUP BY ALL
),
stops AS (
  SELECT c.repo, c.path, c.pos,
    min(l.pos) FILTER (l.pos > c.pos AND l.t <> '' AND l.ind <= c.ind) AS dedent,
    min(l.pos) FILTER (l.pos > c.pos AND l.t <> '' AND l.ind <= c.ind
      AND NOT regexp_matches(l.t, '^[{{}}()\\[\\];,]*$|^end[;.]?$')) AS scope_stop,
    min(l.pos) FILTER (l.pos > c.pos AND l.t <> '' AND ((l.ind = c.ind AND regexp_matches(l.t, '^end\\b')) OR l.ind < c.ind)) AS end_word,
    min_by(l.ind, l.pos) FILTER (l.pos > c.pos AND l.t <> '' AND ((l.ind = c.ind AND regexp_matches(l.t, '^end\\b')) OR l.ind < c.ind)) AS end_ind,
    min(l.pos) FILTER (contains(l.code, ';')) AS semicolon,
    min(l.pos) FILTER (l.opens_to - c.opens_to + c.opens > 0 AND l.net_to - c.net_to + c.opens - c.closes <= 0
      AND NOT regexp_matches(l.tcode, '(?:=>|[=(,.+\\-*/&|?:])$')
      AND NOT (l.pos = c.pos AND coalesce(x.next_t, '') LIKE '{{%')) AS closed,
    min(l.pos) FILTER (l.pos > c.pos AND l.opens_to - c.opens_to + c.opens = 0 AND l.t <> '' AND l.t NOT LIKE '{{%') AS unopened,
    max(c.n) AS n
  FROM named c
  JOIN depths l ON l.repo = c.repo AND l.path = c.path AND l.pos BETWEEN c.pos AND c.pos + 400
  LEFT JOIN next_lines x ON x.repo = c.repo AND x.path = c.path AND x.pos = c.pos
  GROUP BY c.repo, c.path, c.pos
),
indented AS (
  SELECT c.repo, c.path, c.pos, max(l.pos) AS last_line
  FROM named c JOIN stops s USING (repo, path, pos)
  JOIN lines l ON l.repo = c.repo AND l.path = c.path AND l.t <> ''
    AND l.pos >= c.pos AND l.pos < coalesce(s.dedent, least(c.n, c.pos + 401))
  GROUP BY ALL
),
ended AS (
  SELECT c.*, s.scope_stop, CASE c.lang
    WHEN 'py' THEN i.last_line
    WHEN 'sql' THEN coalesce(s.semicolon, least(c.n - 1, c.pos + 400))
    WHEN 'ruby' THEN CASE
      WHEN regexp_matches(c.t, '\\bend\\s*$') THEN c.pos
      WHEN s.end_word IS NULL THEN i.last_line
      WHEN s.end_ind = c.ind THEN s.end_word ELSE s.end_word - 1 END
    ELSE CASE WHEN s.unopened < coalesce(s.closed, s.unopened + 1) THEN c.pos ELSE coalesce(s.closed, i.last_line) END
    END AS last
  FROM named c JOIN stops s USING (repo, path, pos) JOIN indented i USING (repo, path, pos)
),
scopes AS (
  SELECT c.repo, c.path, c.pos, c.name, c.ind, least(c.last, coalesce(c.scope_stop - 1, c.last)) AS scope_last,
    coalesce(min_by(l.ind, l.pos) FILTER (l.t NOT IN ('', '{{') AND l.ind > c.ind), c.ind + 1) AS member_ind
  FROM ended c LEFT JOIN lines l ON l.repo = c.repo AND l.path = c.path AND l.pos > c.pos AND l.pos <= c.last
  WHERE c.rule = 'class' AND c.ind = 0 AND c.lang <> 'sql'
  GROUP BY c.repo, c.path, c.pos, c.name, c.ind, c.last, c.scope_stop
),
tops AS (SELECT repo, path, pos, last FROM ended WHERE rule IN ('def', 'class') AND ind = 0),
placed AS (
  SELECT c.*, s.name AS parent,
    CASE
      WHEN c.rule IN ('route', 'job', 'decorator', 'jobmark') THEN true
      WHEN s.pos IS NOT NULL THEN c.ind = s.member_ind
      WHEN c.rule = 'member' THEN false
      WHEN c.ind > (CASE c.lang WHEN 'js' THEN 2 ELSE 0 END) THEN false
      WHEN c.ind = 0 THEN true
      ELSE NOT EXISTS (SELECT 1 FROM tops t WHERE t.repo = c.repo AND t.path = c.path AND t.pos < c.pos AND t.last >= c.pos)
    END AS taken
  FROM ended c LEFT JOIN scopes s
    ON s.repo = c.repo AND s.path = c.path AND c.pos > s.pos AND c.pos <= s.scope_last AND c.ind > s.ind
),
marks AS (SELECT * FROM placed WHERE rule IN ('decorator', 'jobmark')),
pending AS (
  SELECT d.repo, d.path, d.pos, max(m.pos) AS mark_pos, max_by(m.rule, m.pos) AS mark, max_by(m.line, m.pos) AS mark_line
  FROM placed d JOIN marks m ON m.repo = d.repo AND m.path = d.path AND m.pos < d.pos AND d.pos - m.pos <= 8
  WHERE d.rule IN ('def', 'class') AND d.taken AND NOT EXISTS (
    SELECT 1 FROM feats b WHERE b.repo = d.repo AND b.path = d.path AND b.pos > m.pos AND b.pos < d.pos
      AND b.t <> '' AND NOT b.cmt AND NOT b.dec)
  GROUP BY ALL
),
heads AS (
  SELECT p.*, CASE WHEN m.mark = 'decorator' THEN coalesce(nullif(upper(regexp_replace(regexp_extract(
      m.mark_line, 'methods\\s*=\\s*[\\[(]([^\\])]*)', 1), '[''"\\s]', '', 'g')), ''),
      CASE WHEN contains(m.mark_line, '.route(') THEN 'GET' ELSE upper(regexp_extract(m.mark_line, '\\.(\\w+)\\(', 1)) END) END AS verb,
    regexp_extract(m.mark_line, '\\(\\s*[''"]([^''"]+)', 1) AS verb_path, m.mark = 'jobmark' AS timed
  FROM placed p LEFT JOIN pending m USING (repo, path, pos)
  WHERE p.taken AND p.rule NOT IN ('decorator', 'jobmark')
),
bodies AS (
  SELECT h.repo, h.path, h.pos, string_agg(l.line, chr(10) ORDER BY l.pos) AS body
  FROM heads h JOIN lines l ON l.repo = h.repo AND l.path = h.path AND l.pos BETWEEN h.pos AND h.last
  GROUP BY ALL
),
anchors AS (
  SELECT h.repo, h.path, h.pos, h.lang, max(l.pos) AS anchor
  FROM heads h JOIN feats l ON l.repo = h.repo AND l.path = h.path AND l.pos < h.pos AND NOT l.dec
  GROUP BY ALL
),
runs AS (
  SELECT a.*, coalesce(max(l.pos), -1) AS before
  FROM anchors a LEFT JOIN feats l ON l.repo = a.repo AND l.path = a.path AND l.pos <= a.anchor AND NOT l.cmt
  GROUP BY a.repo, a.path, a.pos, a.lang, a.anchor
),
line_comments AS (
  SELECT repo, path, pos, {_joined("parts")} AS comment FROM (
    SELECT r.repo, r.path, r.pos, list(trim(regexp_replace(l.t, '^(?://|#|--)[/#!\\-]*', '')) ORDER BY l.pos) AS parts
    FROM runs r JOIN feats l ON l.repo = r.repo AND l.path = r.path AND l.pos > r.before AND l.pos <= r.anchor
    GROUP BY ALL)
),
block_open AS (
  SELECT r.repo, r.path, r.pos, r.anchor, max(l.pos) AS open_pos
  FROM runs r
  JOIN feats e ON e.repo = r.repo AND e.path = r.path AND e.pos = r.anchor AND e.t LIKE '%*/'
  JOIN feats l ON l.repo = r.repo AND l.path = r.path AND l.pos <= r.anchor AND l.pos > r.anchor - 60 AND l.t LIKE '/*%'
  WHERE r.before = r.anchor AND r.lang IN ('js', 'sql')
  GROUP BY ALL
),
block_comments AS (
  SELECT repo, path, pos, {_joined("parts")} AS comment FROM (
    SELECT b.repo, b.path, b.pos, list(trim(regexp_replace(regexp_replace(regexp_replace(l.t, '^/[*]', ''), '[*]/$', ''), '^[*]+\\s?', '')) ORDER BY l.pos) AS parts
    FROM block_open b JOIN feats l ON l.repo = b.repo AND l.path = b.path AND l.pos BETWEEN b.open_pos AND b.anchor
    GROUP BY ALL)
),
doc_open AS (
  SELECT h.repo, h.path, h.pos, min(l.pos) AS open_pos, min_by(l.t, l.pos) AS t
  FROM heads h JOIN lines l ON l.repo = h.repo AND l.path = h.path AND l.pos > h.pos AND l.pos <= h.pos + 12 AND l.t <> ''
  WHERE h.lang = 'py' GROUP BY ALL
),
doc_close AS (
  SELECT d.*, left(d.t, 3) AS q, min(l.pos) AS close_pos
  FROM doc_open d LEFT JOIN lines l ON l.repo = d.repo AND l.path = d.path AND l.pos > d.open_pos AND l.pos <= d.open_pos + 30 AND l.t LIKE '%' || left(d.t, 3)
  WHERE left(d.t, 3) IN ('\"\"\"', '''''''') GROUP BY ALL
),
docs AS (
  SELECT repo, path, pos, {_joined("parts")} AS comment FROM (
    SELECT d.repo, d.path, d.pos, list(trim(replace(l.t, d.q, '')) ORDER BY l.pos) AS parts
    FROM doc_close d JOIN lines l ON l.repo = d.repo AND l.path = d.path AND l.pos >= d.open_pos
      AND l.pos <= CASE WHEN length(d.t) >= 6 AND d.t LIKE '%' || d.q THEN d.open_pos ELSE d.close_pos END
    GROUP BY ALL)
),
routes AS (
  SELECT repo, component, min_by(route, path) AS route FROM (
    SELECT repo, path, regexp_extract(line, '<Route path="([^"]+)" component=\\{{(\\w+)\\}}', 1) AS route,
      regexp_extract(line, '<Route path="([^"]+)" component=\\{{(\\w+)\\}}', 2) AS component
    FROM lines WHERE lang = 'js' AND line LIKE '%<Route %')
  WHERE component <> '' GROUP BY ALL
),
headers AS (
  SELECT f.repo, f.path, f.lang, f.n, min(l.pos) AS first_pos, min_by(l.t, l.pos) AS first_t
  FROM (SELECT repo, path, lang, len(ls) AS n FROM arrays) f JOIN lines l ON l.repo = f.repo AND l.path = f.path AND l.t <> ''
  GROUP BY ALL
),
header_stop AS (
  SELECT h.*, coalesce(min(l.pos) FILTER (NOT l.cmt), h.n) AS stop,
    min(l.pos) FILTER (l.t LIKE '%*/') AS block_stop
  FROM headers h JOIN feats l ON l.repo = h.repo AND l.path = h.path AND l.pos >= h.first_pos
  GROUP BY h.repo, h.path, h.lang, h.n, h.first_pos, h.first_t
),
file_heads AS (
  SELECT repo, path, lang, n, {_joined("parts")} AS header FROM (
    SELECT h.repo, h.path, h.lang, h.n, CASE
      WHEN h.stop > h.first_pos THEN list(trim(regexp_replace(l.t, '^(?://|#|--)[/#!\\-]*', '')) ORDER BY l.pos) FILTER (l.pos < h.stop AND l.pos >= h.first_pos)
      WHEN h.first_t LIKE '/*%' AND h.lang IN ('js', 'sql') THEN list(trim(regexp_replace(regexp_replace(regexp_replace(l.t, '^/[*]', ''), '[*]/$', ''), '^[*]+\\s?', '')) ORDER BY l.pos) FILTER (l.pos <= h.block_stop AND l.pos >= h.first_pos)
      WHEN h.first_t LIKE '\"\"\"%' AND h.lang = 'py' THEN [trim(replace(h.first_t, '\"\"\"', ''))]
      ELSE ['x'][2:] END AS parts
    FROM header_stop h JOIN feats l ON l.repo = h.repo AND l.path = h.path
    GROUP BY h.repo, h.path, h.lang, h.n, h.stop, h.first_pos, h.first_t, h.block_stop)
),
described AS (
  SELECT h.*, b.body, coalesce(CASE WHEN h.rule IN ('def', 'class') THEN nullif(d.comment, '') END, c.comment, k.comment, '') AS comment,
    coalesce(h.lang = 'js' AND h.rule = 'def' AND h.parent IS NULL AND regexp_matches(h.name, '^[A-Z]')
      AND regexp_matches(b.body, '(?m)<[A-Z][\\w.]*[\\s/>]|<>|return\\s*\\(\\s*$|return\\s*\\(\\s*<'), false) AS shows
  FROM heads h JOIN bodies b USING (repo, path, pos)
  LEFT JOIN docs d USING (repo, path, pos) LEFT JOIN line_comments c USING (repo, path, pos)
  LEFT JOIN block_comments k USING (repo, path, pos)
),
mined AS (
  SELECT d.repo, d.path, d.lang, d.pos, d.last, d.comment, d.body, d.line, d.parent,
    CASE WHEN d.rule = 'route' THEN upper(regexp_extract(d.line, '(get|post|put|delete)[\\s(]', 1)) ELSE d.verb END AS method,
    CASE WHEN d.rule = 'route' THEN regexp_extract(d.line, '[''"`]([^''"`]+)', 1) WHEN d.verb IS NOT NULL THEN d.verb_path END AS url,
    CASE WHEN d.verb IS NOT NULL THEN d.name END AS handler,
    CASE WHEN d.lang = 'sql' THEN split_part(d.name, ' ', 1) END AS kind,
    CASE WHEN d.shows THEN r.route END AS route,
    CASE WHEN d.rule = 'route' OR d.verb IS NOT NULL THEN 'endpoint'
      WHEN d.rule = 'job' OR d.timed THEN 'job'
      WHEN d.shows THEN CASE WHEN r.route IS NULL THEN 'component' ELSE 'page' END
      WHEN d.rule = 'class' THEN 'class' WHEN d.parent IS NOT NULL THEN 'method' ELSE 'function' END AS type,
    CASE WHEN d.rule = 'job' THEN 'cron ' || regexp_extract(d.line, 'schedule\\(\\s*[''"`]([^''"`]+)', 1)
      WHEN d.timed OR d.verb IS NULL THEN d.name END AS plain_name
  FROM described d LEFT JOIN routes r ON r.repo = d.repo AND r.component = d.name
),
whole AS (
  SELECT f.repo, f.path, f.lang, 0 AS pos, f.n - 1 AS last, f.header AS comment,
    array_to_string(a.ls, chr(10)) AS body, '' AS line, NULL AS parent, NULL AS method, NULL AS url, NULL AS handler,
    NULL AS kind, NULL AS route, 'file' AS type, string_split(f.path, '/')[-1] AS plain_name
  FROM file_heads f JOIN arrays a USING (repo, path)
  WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.repo = f.repo AND h.path = f.path)
),
joined AS (SELECT * FROM mined UNION ALL BY NAME SELECT * FROM whole),
bare AS (
  SELECT *, CASE WHEN type = 'endpoint' THEN method || ' ' || url ELSE plain_name END AS name,
    CASE WHEN lang IN ('js', 'py') THEN regexp_replace(body, '(?m)^\\s*(?:import|from)\\s.*$', '', 'g') ELSE body END AS code_text
  FROM joined
),
units AS (
  SELECT repo, path || ':' || (pos + 1) || ' ' || name AS id, path AS file, lang, type, name,
    CAST(pos + 1 AS INTEGER) AS first_line, CAST(last + 1 AS INTEGER) AS last_line, comment,
    CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS area,
    method, url AS path, handler, parent, kind, route,
    list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(code_text,
      '(?i)\\b(?:from|join|into|update|table\\s+if\\s+not\\s+exists|table)\\s+[`"\\[]?([A-Za-z_][A-Za-z0-9_]*)\\b', 1)
      IF length(x) > 2 AND NOT list_contains([{_STOP}], lower(x))])) AS tables,
    CASE WHEN lang = 'js' THEN list_sort(list_distinct([x FOR x IN [regexp_replace(y, '^(?:\\$\\{{[^}}]*\\}})+', '') FOR y IN
      regexp_extract_all(body, '\\b(?:fetch|axios\\.(?:get|post))\\(\\s*[''"`]([^''"`\\n]*)[''"`]', 1)] IF x LIKE '/%'])) END AS calls,
    CASE WHEN lang = 'js' THEN list_sort(list_distinct(regexp_extract_all(body, '\\b(?:io|socket)\\.emit\\(\\s*[''"`]([^''"`]+)', 1))) END AS emits,
    CASE WHEN lang = 'js' THEN list_sort(list_distinct(regexp_extract_all(body, '\\brequire\\(\\s*[''"](\\.{{1,2}}/[^''"]+)', 1))) END AS imports,
    CASE WHEN lang = 'js' AND type = 'endpoint' THEN [trim(x) FOR x IN string_split(regexp_extract(line, '[''"`],\\s*(.*?),\\s*async', 1), ',') IF trim(x) <> ''] END AS middleware
  FROM bare
)"""


def units_query(select: str, more: str = "") -> str:
    """A check that selects from ``units`` (and the CTEs in ``more``)."""
    return f"WITH {UNITS}{', ' + more if more else ''}\n{select}"


def files_query(select: str, more: str = "") -> str:
    return f"WITH {FILES}{', ' + more if more else ''}\n{select}"
