"""Queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelode.functions import paths as P
from codelode.functions import text as T
from codelode.operators import describe as D
from codelode.operators import evaluate as E
from codelode.operators import extract as X
from codelode.operators import retrieve as R
from codelode.operators.extras import TABLE_STOP_WORDS, tables_in
from codelode.operators.routes import route_table
from codelode.plans.bench import bench
from codelode.plans.build import build_map, scanned
from codelode.plans.find import find
from codelode.queries.check_code import files_query, units_query
from codelode.queries.check_sql import split_ctes, stem_ctes, tokens
from codelode.queries.codebase import code_files
from codelode.queries.languages import FIELDS, found_sql, more_files
from codelode.sources import corpus as C
from codelode.sources import mapstore as M
from codelode.sources.scratch import ROWS_PER_TASK, dealt, saved, shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- documents as units


def doc_units(spark: SparkSession, sf_dir: str, one_file_each: bool = False) -> DataFrame:
    """Documents as units: the source is the file (or one file per document)."""
    docs = dealt(table(spark, sf_dir, "documents"), ROWS_PER_TASK)
    file = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")) if one_file_each else (
        F.col("source"))
    return docs.select(
        F.regexp_replace("source", "[0-9]+$", "").alias("repo"),
        F.col("doc_id").cast("string").alias("id"), file.alias("file"), F.lit(None).cast("string").alias("lang"), F.lit("file").alias("type"),
        F.lit("").alias("name"), F.col("doc_id").alias("start"), F.col("doc_id").alias("end"), F.lit("").alias("comment"),
        F.col("text").alias("description"), F.col("lang").alias("area"),
        F.lit(None).cast(X.EXTRA_TYPE).alias("extra"))


def bench_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.lit("src").alias("repo"), F.col("item_id").cast("string").alias("task_id"), "text")


def scores_sql(file: str, parts: str) -> str:
    """CTEs ending in scored(item, part_no, file, doc, score, rank) for a CTE
    parts(item, part_no, part)."""
    return f"""
{parts},
docs AS (
  SELECT doc_id AS doc, {file} AS file,
    {tokens("concat_ws(' ', CAST(doc_id AS varchar), " + file + ", lang, text)")} AS ws,
    {tokens(file)} AS ns
  FROM documents
),
doc_words AS (SELECT DISTINCT doc, file, unnest(ws) AS word FROM docs),
name_words AS (SELECT DISTINCT doc, unnest(ns) AS word FROM docs),
part_words AS (SELECT DISTINCT item, part_no, unnest({tokens("part")}) AS word FROM parts),
vocab AS (SELECT word FROM doc_words UNION SELECT word FROM part_words UNION SELECT word FROM name_words),
{stem_ctes("vocab")},
doc_stems AS (SELECT DISTINCT doc, file, stem FROM doc_words JOIN stems USING (word)),
name_stems AS (SELECT DISTINCT doc, stem FROM name_words JOIN stems USING (word)),
part_stems AS (SELECT DISTINCT item, part_no, stem FROM part_words JOIN stems USING (word)),
scores AS (
  SELECT item, part_no, file, d.doc, sum(CASE WHEN n.doc IS NULL THEN 1.0 ELSE 1.5 END) AS score
  FROM part_stems p JOIN doc_stems d USING (stem) LEFT JOIN name_stems n ON n.doc = d.doc AND n.stem = d.stem
  GROUP BY ALL
),
scored AS (
  SELECT item, part_no, file, doc, CAST(score AS double) AS score,
    row_number() OVER (PARTITION BY item, part_no ORDER BY score DESC, file, doc) AS rank
  FROM scores
)"""


WHOLE_ITEMS = (
    "parts AS (SELECT CAST(item_id AS varchar) AS item, 1 AS part_no, trim(text) AS part FROM benchmark)"
)


def _prefiltered(spark: SparkSession, sf_dir: str, early: bool = False) -> DataFrame:
    parts = R.parts(bench_tasks(spark, sf_dir), "none")
    index = R.token_index(doc_units(spark, sf_dir))
    return R.prefilter(parts, saved(index, "stems") if early else index, early=early)


BEST_DOCUMENTS = (f"WITH {scores_sql('source', WHOLE_ITEMS)} "
                  "SELECT item AS task_id, rank, file, doc AS doc_id, score FROM scored WHERE rank <= 40")


@query(BEST_DOCUMENTS)
def prefilter_topk(spark, sf_dir):
    """The 40 best documents of every benchmark item by keyword score."""
    return _prefiltered(spark, sf_dir).select(
        "task_id", "rank", "file", F.col("start").cast("bigint").alias("doc_id"), "score")


@query(BEST_DOCUMENTS)
def prefilter_early(spark, sf_dir):
    """The same from a stored index, without the pairs that cannot be among them."""
    return _prefiltered(spark, sf_dir, early=True).select(
        "task_id", "rank", "file", F.col("start").cast("bigint").alias("doc_id"), "score")


RANKED_FILES = """
, files_best AS (SELECT item, part_no, file, max(score) AS score, min(rank) AS r FROM scored WHERE rank <= 40 GROUP BY ALL)
, files_ranked AS (SELECT *, row_number() OVER (PARTITION BY item, part_no ORDER BY r) AS rank FROM files_best)
"""


@query(f"WITH {scores_sql('source', WHOLE_ITEMS)} {RANKED_FILES} "
       "SELECT item AS task_id, rank, file, score FROM files_ranked WHERE rank <= 10")
def rank_files(spark, sf_dir):
    """The 10 best files of every item, by their best unit."""
    return R.rank_files(_prefiltered(spark, sf_dir), by="score").select(
        "task_id", "rank", "file", "score")


@query(f"""SELECT word AS token, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest({tokens("text")}) AS word FROM documents) GROUP BY ALL""")
def tokens_vocab(spark, sf_dir):
    """How often, and in how many documents, each token occurs."""
    rows = dealt(table(spark, sf_dir, "documents")).select(
        "doc_id", F.explode(T.tokenize(F.col("text"))).alias("token"))
    per_doc = rows.groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH vocab AS (SELECT DISTINCT unnest({tokens("text")}) AS word FROM documents),
{stem_ctes("vocab")} SELECT word AS token, stem FROM stems""")
def stem_vocab(spark, sf_dir):
    """Stem of every distinct token."""
    return dealt(table(spark, sf_dir, "documents")).select(
        F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token")
    ).distinct().select("token", T.stem(F.col("token")).alias("stem"))


@query(f"""SELECT doc_id, len(list_intersect(list_distinct(ws), [w FOR w IN {tokens("'the them with that'")} ])) AS unused,
 strip_accents(text) AS folded FROM (SELECT doc_id, text, {tokens("text")} AS ws FROM documents)""")
def fold_text(spark, sf_dir):
    """Folded texts of documents, and the stop words left among their tokens (none)."""
    return dealt(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size(F.array_intersect(T.tokenize(F.col("text")), T.tokenize(
            F.lit("the them with that")))).cast("bigint").alias("unused"),
        T.fold(F.col("text")).alias("folded"))


TURNS = "SELECT concat(conv_id, '/', turn, '/', role) AS id, text FROM conversations"
ROLE = "split_part(id, '/', 3) AS role"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a task; the role is part of its id."""
    return dealt(table(spark, sf_dir, "conversations")).select(
        F.lit("talk").alias("repo"), F.concat_ws("/", "conv_id", "turn", "role").alias("task_id"),
        "text")


def _role() -> Column:
    return F.split_part(F.col("task_id"), F.lit("/"), F.lit(3)).alias("role")


@query(f"""SELECT id, {ROLE}, regexp_matches(text, '[\\n;•]|,\\s*\\w+\\s+\\w+') OR
 len([w FOR w IN regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+') IF w <> '']) > 14 AS composite
FROM ({TURNS})""")
def composite_tasks(spark, sf_dir):
    """Which turns look like several tasks."""
    return _turns(spark, sf_dir).select(
        F.col("task_id").alias("id"), _role(), T.looks_composite(F.col("text")).alias("composite"))


@query(f"WITH {split_ctes(TURNS)} SELECT id, {ROLE}, part_no, part FROM parts")
def split_tasks(spark, sf_dir):
    """Parts of the turns."""
    return R.parts(_turns(spark, sf_dir)).select(
        F.col("task_id").alias("id"), _role(), F.col("part_no").cast("bigint").alias("part_no"), "part")


# --------------------------------------------------------------- corpus

@query("""SELECT kind, id, coalesce(list_max([length(l) FOR l IN string_split(text, chr(10))]) > 2000
 OR (length(text) - len(string_split(text, chr(10))) + 1) / len(string_split(text, chr(10))) > 300, false) AS minified
FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)""")
def minified_files(spark, sf_dir):
    """Which documents and pages would be skipped as minified."""
    docs = dealt(table(spark, sf_dir, "documents")).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = dealt(table(spark, sf_dir, "pages")).select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("kind", "id", C.is_minified(F.col("text")).alias("minified"))


@query(files_query("SELECT repo, path, lang FROM listed"))
def list_files(spark, sf_dir):
    """Files of the derived codebase that are scanned."""
    return C.list_files(code_files(spark, sf_dir)).select(
        "repo", "path", P.detect_lang(F.col("path")).alias("lang"))


@query(files_query("""SELECT repo, path FROM spoken
WHERE (regexp_matches(path, '^brand1[^/]*(/|$)') OR regexp_matches(path, '(^|/)f[0-9]*[.]txt(/|$)'))
 AND NOT regexp_matches(path, '(^|/)node_modules(/|$)') AND NOT regexp_matches(path, '[.]sql$')
 AND (lang IS NOT NULL OR regexp_matches(path, '(^|/)f[0-9]*[.]txt$'))"""))
def list_files_included(spark, sf_dir):
    """Include and exclude globs; files of no known language need a glob that names them."""
    return C.list_files(code_files(spark, sf_dir), include=["brand1*/**", "f*.txt"],
                        exclude=["**/*.sql"]).select("repo", "path")


@query("""SELECT url, CAST(NULL AS varchar) AS lang,
 CASE WHEN regexp_matches(split_part(rel, '/', -1), '(?i)^[0-9]*5$') THEN 'five' WHEN regexp_matches(rel, '(?i)/FR/') THEN 'french'
  WHEN contains(rel, '/') AND rel NOT LIKE '/%' THEN split_part(rel, '/', 1) ELSE 'root' END AS area,
 regexp_matches(rel, '(^|/)[^/]*[.]example[.]org(/|$)') AS org,
 regexp_matches(rel, '^(?:(?:.*/)?en/[^/]*)(/.*)?$') AS english
FROM (SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS rel FROM pages)""")
def path_filters(spark, sf_dir):
    """Language, area and glob tests on the paths of page addresses."""
    rel = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*\z", "")
    areas = [("(", "broken"), ("^[0-9]*5$", "five"), ("/FR/", "french")]
    return table(spark, sf_dir, "pages").select("url", rel.alias("rel")).select(
        "url", P.detect_lang(F.col("rel")).alias("lang"), P.area_of(F.col("rel"), areas).alias("area"),
        P.glob_match(F.col("rel"), "*.example.org").alias("org"),
        P.glob_match(F.col("rel"), "**/en/*").alias("english"))


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of fifty names per source, so paths repeat, a hundred times their size."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("repo"), F.concat("source", F.lit("/n"), (F.col("doc_id") % 50).cast("string"), F.when(
            F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".js").otherwise(".dat")).alias("path"),
        (F.length(F.coalesce("text", F.lit(""))) * 100).cast("bigint").alias("size"),
        F.coalesce("text", F.lit("")).alias("text"))


@query("""SELECT repo, path, size, md5(text) AS digest FROM (
 SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY size, text) AS n FROM (
  SELECT lang AS repo, source || '/n' || (doc_id % 50) || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.dat' END AS path,
   length(coalesce(text, '')) * 100 AS size, coalesce(text, '') AS text FROM documents)
 WHERE NOT path LIKE '%.dat' AND size <= 1048576) WHERE n = 1""")
def listed_once(spark, sf_dir):
    """Files of known languages up to the size limit, one for each path."""
    return C.list_files(_document_files(spark, sf_dir)).select("repo", "path", "size", F.md5("text").alias("digest"))


@query("""SELECT lang AS repo, source || '/n' || (doc_id % 50) || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.dat' END AS path,
 length(text) * 100 AS size FROM documents WHERE length(text) * 100 > 1048576""")
def oversized_files(spark, sf_dir):
    """Files that the size limit leaves out."""
    return C.oversized(_document_files(spark, sf_dir))


IGNORE_TEXT = "# Ignored here\n*.sql\n!f1*.sql\nbrand2/\n!brand2/f7.py\nbrand3*/f?.*\n"


@query(files_query("""SELECT repo, path FROM files WHERE NOT (
 list_contains(string_split(path, '/'), 'brand2')
 OR CASE WHEN regexp_matches(path, '^(?:node_modules/)?brand3[^/]*/f[^/][.][^/]*$') AND path NOT LIKE 'node_modules/%' THEN true
   WHEN regexp_matches(path, '(^|/)f1[^/]*[.]sql(/|$)') THEN false
   ELSE regexp_matches(path, '[.]sql(/|$)') END)"""))
def ignored_files(spark, sf_dir):
    """Paths that the ignore file of their repository leaves: the last rule decides, and
    nothing below an ignored directory comes back."""
    files = code_files(spark, sf_dir).select("repo", "path")
    rules = files.select("repo").distinct().select(
        "repo", F.lit(".gitignore").alias("path"), F.lit(IGNORE_TEXT).alias("text"))
    return C.ignore_filter(files, C.ignore_rules(rules))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(text,
 '(?i)\\b(?:from|join|into|update|table\\s+if\\s+not\\s+exists|table)\\s+[`"\\[]?([A-Za-z_][A-Za-z0-9_]*)\\b', 1)
 IF length(x) > 2 AND NOT list_contains(string_split('""" + " ".join(TABLE_STOP_WORDS) + """', ' '), lower(x))])), '|') AS tables FROM documents""")
def tables_mined(spark, sf_dir):
    """What looks like SQL tables in the whole text of every document."""
    return dealt(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join(tables_in(F.col("text"), F.lit(False)), "|").alias("tables"))


# --------------------------------------------------------------- units of the codebase

def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mine_files(scanned(code_files(spark, sf_dir), unique=True))


def code_map(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    return build_map(code_files(spark, sf_dir), unique=True, **options)


LISTS = ["tables", "calls", "emits", "imports", "middleware"]
UNIT_COLUMNS = (
    "repo, id, file, lang, type, name, first_line, last_line, comment, area, method, path, handler, "
    "parent, kind, route, " + ", ".join(f"nullif(array_to_string({c}, '|'), '') AS {c}" for c in LISTS)
)


def flat_units(units: DataFrame) -> DataFrame:
    extra = [F.col(f"extra.{c}").alias(c) for c in ("method", "path", "handler", "parent", "kind",
                                                    "route")]
    lists = [F.array_join(F.col(f"extra.{c}"), "|").alias(c) for c in LISTS]
    return units.select(
        "repo", "id", "file", "lang", "type", "name", F.col("start").alias("first_line"),
        F.col("end").alias("last_line"), "comment", "area", *extra, *lists)


@query(units_query(f"SELECT {UNIT_COLUMNS} FROM units"))
def code_units(spark, sf_dir):
    """All units of the derived codebase."""
    return flat_units(code_map(spark, sf_dir)[0])


@query(found_sql())
def code_units_more(spark, sf_dir):
    """Units of files in the other languages, with class prefixes, route objects and imports."""
    units, _ = build_map(more_files(spark, sf_dir), unique=True)
    return flat_units(units).select("repo", "file", *FIELDS)


@query(units_query(f"SELECT {UNIT_COLUMNS} FROM units"))
def map_round_trip(spark, sf_dir):
    """All units of the derived codebase, written as a map and loaded again."""
    path = f"{shared_folder(spark)}/codelode/map-{uuid.uuid4().hex}"
    M.write_map(*code_map(spark, sf_dir), path, project="demo")
    units, _ = M.load_map(spark, path)
    return flat_units(units)


@query(files_query("""SELECT 'repo=' || repo AS repo, sum(length(text) + 1)::bigint AS chars,
 sum(length(text) - length(replace(text, chr(10), '')) + 1)::bigint AS line_ends FROM files GROUP BY ALL"""))
def load_corpus(spark, sf_dir):
    """The derived codebase written as text, a folder per repository, and read as a corpus."""
    path = f"{shared_folder(spark)}/codelode/corpus-{uuid.uuid4().hex}"
    code_files(spark, sf_dir).select("repo", "text").write.partitionBy("repo").text(path)
    ends = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return C.load_files(spark, path).where(F.endswith("path", F.lit(".txt"))).groupBy("repo").agg(
        F.sum(F.length("text").cast("bigint")).alias("chars"),
        F.sum(ends.cast("bigint")).alias("line_ends"))


@query(units_query("""SELECT repo, path, CAST(pos AS bigint) AS pos, line, CAST(ind AS bigint) AS indent
FROM lines"""))
def code_lines(spark, sf_dir):
    """Lines of the scanned files."""
    lines = C.explode_lines(scanned(code_files(spark, sf_dir), unique=True))
    indent = F.length("line") - F.length(F.ltrim(F.col("line"), F.lit(" \t")))
    return lines.select("repo", "path", F.col("pos").cast("bigint").alias("pos"), "line",
                        indent.cast("bigint").alias("indent"))


@query(units_query("""SELECT h.repo, h.path AS file, h.lang, CAST(h.n AS bigint) AS lines,
 split_part(h.path, '/', 1) AS area, h.header, count(*) AS n_units
FROM file_heads h JOIN units u ON u.repo = h.repo AND u.file = h.path GROUP BY ALL"""))
def code_headers(spark, sf_dir):
    """File table: lines, language, area, header comment, number of units."""
    return X.file_stats(_mined(spark, sf_dir)).select(
        "repo", "file", "lang", F.col("lines").cast("bigint").alias("lines"), "area", "header",
        F.col("n_units").cast("bigint").alias("n_units"))


@query(units_query("""SELECT repo, method, path, coalesce(handler, '') AS handler, count(*) AS n
FROM units WHERE type = 'endpoint' GROUP BY ALL"""))
def code_endpoints(spark, sf_dir):
    """Endpoints of every repository."""
    units = _units_without_routes(spark, sf_dir).where(F.col("type") == "endpoint")
    return units.groupBy(
        "repo", F.col("extra.method").alias("method"), F.col("extra.path").alias("path"),
        F.coalesce("extra.handler", F.lit("")).alias("handler")).agg(F.count("*").alias("n"))


def _units_without_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units, saved: filters and joins on them would otherwise work the mining out again."""
    return saved(X.mined_units(_mined(spark, sf_dir)), "units")


@query(units_query("SELECT repo, component, route FROM routes"))
def code_routes(spark, sf_dir):
    """Route table of every repository."""
    return route_table(scanned(code_files(spark, sf_dir), unique=True))


@query(units_query(r"""SELECT repo, path, endpoint, caller, call FROM (
 SELECT *, min(mask) OVER (PARTITION BY repo, call) AS best FROM (
  SELECT e.repo, e.path, e.id AS endpoint, c.id AS caller, c.call,
   array_to_string(list_transform(e.segs, lambda s: CASE WHEN s = '*' THEN '1' ELSE '0' END), '') AS mask
  FROM (SELECT *, string_split(regexp_replace(path, '\{[^}]*\}|<[^>]*>|:\w+', '*', 'g'), '/') AS segs
   FROM units WHERE type = 'endpoint') e
  JOIN (SELECT repo, id, call, string_split(regexp_replace(regexp_replace(call, '\?.*', ''), '\$\{[^}]*\}', '*', 'g'), '/') AS segs
   FROM (SELECT repo, id, unnest(calls) AS call FROM units)) c
  ON c.repo = e.repo AND len(c.segs) = len(e.segs)
   AND list_bool_and(list_transform(list_zip(c.segs, e.segs), lambda z: z[2] = '*' OR z[1] = z[2]))))
WHERE mask = best"""))
def code_callers(spark, sf_dir):
    """Which units call which endpoints."""
    return R.callers_of(_units_without_routes(spark, sf_dir))


@query(units_query("""SELECT type, count(*) AS n, count(*) FILTER (comment = '') AS without_description
FROM units GROUP BY ALL"""))
def unit_counts(spark, sf_dir):
    return M.unit_counts(code_map(spark, sf_dir)[0])


@query(units_query("""SELECT repo, 1 AS version, 'demo' AS project, count(DISTINCT file) AS n_files, count(*) AS n_units
FROM units GROUP BY ALL"""))
def map_meta(spark, sf_dir):
    units, stats = code_map(spark, sf_dir)
    return M.map_meta(units, stats, "demo")


@query(units_query("""SELECT repo, t AS name, count(*) AS units, count(DISTINCT file) AS files
FROM (SELECT repo, file, unnest(tables) AS t FROM units) GROUP BY ALL"""))
def table_usage(spark, sf_dir):
    """Which SQL tables are used by how many units and files."""
    rows = _units_without_routes(spark, sf_dir).select(
        "repo", "file", F.explode("extra.tables").alias("name"))
    per_file = rows.groupBy("repo", "name", "file").agg(F.count("*").alias("c"))
    return per_file.groupBy("repo", "name").agg(
        F.sum("c").alias("units"), F.count("*").alias("files"))


INDEX_SQL = """
bullets AS (
  SELECT repo, area, file, first_line AS start, '- `' || first_line || '-' || last_line || '` **' || name || '** - '
    || CASE WHEN comment = '' THEN '(no description)' ELSE left(comment, 200) END
    || CASE WHEN extras = '' THEN '' ELSE ' [' || extras || ']' END AS line
  FROM (SELECT *, concat_ws('; ',
    CASE WHEN len(tables) > 0 THEN 'tables: ' || array_to_string(tables[1:8], ', ') END,
    CASE WHEN len(emits) > 0 THEN 'socket: ' || array_to_string(emits[1:8], ', ') END,
    CASE WHEN len(calls) > 0 THEN 'api: ' || array_to_string(calls[1:8], ', ') END,
    CASE WHEN route <> '' THEN 'route: ' || route END,
    CASE WHEN len(middleware) > 0 THEN 'auth: ' || array_to_string(middleware, ', ') END,
    CASE WHEN parent <> '' THEN 'in: ' || parent END) AS extras FROM units)
)"""


@query(units_query("""SELECT repo, area, file, start, line FROM bullets
UNION ALL SELECT DISTINCT repo, area, NULL, NULL, chr(10) || '## Area: ' || area FROM units
UNION ALL SELECT repo, split_part(path, '/', 1), path, 0, chr(10) || '### ' || path || ' (' || n || ' lines)'
  || CASE WHEN header = '' THEN '' ELSE ' - ' || left(header, 160) END FROM file_heads""", INDEX_SQL))
def index_lines(spark, sf_dir):
    """Readable index: areas, files, units."""
    return M.render_index(*code_map(spark, sf_dir))


# --------------------------------------------------------------- descriptions

NAMES_SQL = """
SELECT concat('r', CAST(p_partkey % 25 AS varchar(20))) AS repo,
 concat(replace(lower(p_brand), '#', ''), '/f', CAST(p_partkey AS varchar(20)),
  CASE p_partkey % 4 WHEN 0 THEN '.py::' WHEN 1 THEN '.js::read' WHEN 2 THEN '.rb::top' ELSE '.sql:1 table ' END,
  CASE p_partkey % 4 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS varchar(20)))
   WHEN 1 THEN concat(upper(substring(p_name, 1, 1)), replace(substring(p_name, 2, 100), ' ', ''))
   WHEN 2 THEN concat('_', CAST(p_partkey AS varchar(20)))
   ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS varchar(20))) END) AS key,
 CASE WHEN p_size % 6 = 0 THEN '  ' ELSE concat('  About ', p_name, ' ') END AS text
FROM part
"""


#: The same keys a second and third time, with other texts.
REPEATED_SQL = f"""
SELECT repo, key, text FROM ({NAMES_SQL}) x
UNION ALL SELECT repo, key, concat('More about ', key) FROM ({NAMES_SQL}) y WHERE length(key) % 3 > 0
UNION ALL SELECT repo, key, '' FROM ({NAMES_SQL}) z
"""


#: A description is little work, so many rows of the table make a task.
DESCRIPTIONS_PER_TASK = 100_000


def repeated_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPEATED_SQL.replace("FROM part", "FROM {part}"),
                     part=dealt(table(spark, sf_dir, "part"), DESCRIPTIONS_PER_TASK))


def part_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NAMES_SQL.replace("FROM part", "FROM {part}"),
                     part=dealt(table(spark, sf_dir, "part"), DESCRIPTIONS_PER_TASK))


@query(units_query("""SELECT repo, id, coalesce(nullif(trim(coalesce(a, b)), ''), comment) AS description FROM (
 SELECT u.repo, u.id, u.comment, x.text AS a, y.text AS b FROM units u
 LEFT JOIN names x ON x.repo = u.repo AND x.key = u.id
 LEFT JOIN names y ON y.repo = u.repo AND y.key = u.file || '::' || u.name)""", f"names AS ({NAMES_SQL})"))
def merge_descriptions(spark, sf_dir):
    """Descriptions given by id or by file and name, merged into the units."""
    units, _ = code_map(spark, sf_dir, descriptions=part_descriptions(spark, sf_dir))
    return units.select("repo", "id", "description")


@query(units_query("""SELECT repo, id, coalesce(nullif(trim(coalesce(a, b)), ''), comment) AS description FROM (
 SELECT u.repo, u.id, u.comment, x.text AS a, y.text AS b FROM units u
 LEFT JOIN names x ON x.repo = u.repo AND x.key = u.id
 LEFT JOIN names y ON y.repo = u.repo AND y.key = u.file || '::' || u.name)""", f"""names AS (
 SELECT repo, key, coalesce(min(text) FILTER (trim(text) <> ''), min(text) FILTER (text <> '')) AS text
 FROM ({REPEATED_SQL}) GROUP BY ALL)"""))
def merge_repeated_descriptions(spark, sf_dir):
    """Descriptions whose keys come several times: units stay one row each."""
    units, _ = code_map(spark, sf_dir, descriptions=repeated_descriptions(spark, sf_dir))
    return units.select("repo", "id", "description")


MISSING_SQL = """missing AS (
 SELECT * FROM units
 WHERE comment = '' AND NOT EXISTS (SELECT 1 FROM names x WHERE x.repo = units.repo AND x.key = units.id))"""


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = part_descriptions(spark, sf_dir).select("repo", F.col("key").alias("id"))
    return D.missing_descriptions(_units_without_routes(spark, sf_dir), done)


@query(units_query("SELECT repo, id, type FROM missing".replace(
    "type", "CASE WHEN type = 'page' THEN 'component' ELSE type END AS type"),
    f"names AS ({NAMES_SQL}), {MISSING_SQL}"))
def missing_descriptions(spark, sf_dir):
    """Units without a description."""
    return _missing(spark, sf_dir).select("repo", "id", "type")


REQUESTS_SQL = f"""names AS ({NAMES_SQL}), {MISSING_SQL},
numbered AS (
 SELECT m.*, CAST(floor((row_number() OVER (PARTITION BY m.repo, m.file ORDER BY first_line) - 1) / 2) AS integer) AS batch_no,
  string_split(c.text, chr(10)) AS ls
 FROM missing m JOIN chosen c ON c.repo = m.repo AND c.path = m.file),
requests AS (
 SELECT repo, file, batch_no, list(id ORDER BY first_line) AS ids,
  'File: ' || file || chr(10) || 'First lines of the file:' || chr(10) || '```' || chr(10)
  || array_to_string(any_value(ls)[1:5], chr(10)) || chr(10) || '```' || chr(10) || chr(10) || 'Units:' || chr(10) || chr(10)
  || string_agg('### id: ' || id || chr(10) || '(' || CASE WHEN type = 'page' THEN 'component' ELSE type END || ' ' || name || ', lines ' || first_line || '-' || last_line || ')'
   || chr(10) || '```' || chr(10) || array_to_string(ls[first_line:last_line], chr(10)) || chr(10) || '```', chr(10) || chr(10) ORDER BY first_line) AS prompt
 FROM numbered GROUP BY repo, file, batch_no)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.description_batches(_missing(spark, sf_dir), code_files(spark, sf_dir), 2)


@query(units_query("SELECT repo, file, batch_no, array_to_string(ids, '|') AS ids, prompt FROM requests",
                   REQUESTS_SQL))
def description_requests(spark, sf_dir):
    """Requests that ask for the missing descriptions, at most two units each."""
    return _requests(spark, sf_dir).withColumn("ids", F.array_join("ids", "|"))


@query(units_query("""SELECT repo, count(*) AS requests, CAST(sum(i) + sum(o) AS bigint) AS tokens,
 floor((sum(i) / 1e6 * 1 + sum(o) / 1e6 * 5) * 1e6 + 0.5) / 1e6 AS cost_usd
FROM (SELECT repo, CAST(floor(length(prompt) / 4 + 0.5) AS bigint) AS i, 60 * len(ids) + 200 AS o FROM requests) GROUP BY ALL""",
    REQUESTS_SQL))
def description_cost(spark, sf_dir):
    """What those requests would cost at most."""
    usage = _requests(spark, sf_dir).select(
        "repo", D.estimated_tokens(F.col("prompt")).alias("input_tokens"),
        (F.size("ids") * 60 + 200).cast("bigint").alias("output_tokens"))
    return D.description_cost(usage)


NEW_SQL = """
SELECT concat('r', CAST(p_partkey % 25 AS varchar(20))) AS repo, concat('k', CAST(p_partkey % 700 AS varchar(20)), '/', p_brand) AS key,
 CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('Old ', p_name) END AS old_text,
 concat(' New  ', p_type, chr(10), p_name, repeat(' and more', p_size)) AS new_text, p_partkey AS pk FROM part
"""


@query(f"""WITH src AS ({NEW_SQL}),
old AS (SELECT repo, key, coalesce(min(old_text) FILTER (trim(old_text) <> ''), '') AS text FROM src WHERE pk % 2 = 0 GROUP BY ALL),
new AS (SELECT repo, key, min(left(trim(regexp_replace(new_text, '\\s+', ' ', 'g')), 160)) AS text FROM src WHERE pk % 3 = 0 GROUP BY ALL),
kept AS (SELECT repo, key FROM old WHERE text <> ''),
added AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.repo = n.repo AND k.key = n.key))
SELECT * FROM added UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM added a WHERE a.repo = o.repo AND a.key = o.key)""")
def new_descriptions(spark, sf_dir):
    """New descriptions merged beside old ones, which are never overwritten; one row per key."""
    src = spark.sql(NEW_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    old = src.where("pk % 2 = 0").select("repo", "key", F.col("old_text").alias("text"))
    new = src.where("pk % 3 = 0").select("repo", "key", F.col("new_text").alias("text"))
    return D.merge_new_descriptions(old, new)


# --------------------------------------------------------------- requests and answers

LABEL_SQL = """labelled AS (SELECT *, concat_ws(' | ', file, CASE WHEN type = 'page' THEN 'component' ELSE type END || ' ' || name,
  CASE WHEN comment <> '' THEN 'does: ' || left(comment, 200) END,
  CASE WHEN len(tables) > 0 THEN 'tables: ' || array_to_string(tables[1:5], ', ') END,
  CASE WHEN len(calls) > 0 THEN 'calls: ' || array_to_string(calls[1:5], ', ') END) AS label,
 row_number() OVER (PARTITION BY repo ORDER BY file, first_line) - 1 AS k FROM units)"""


@query(units_query("""SELECT repo, id, k // 60 AS batch_no, 'q' || (k % 60) AS q,
 'To carry out the task in `task` in the project (demo), a developer must read or modify this code unit: ' || label AS instructions
FROM labelled""", LABEL_SQL))
def scan_questions(spark, sf_dir):
    """One question per unit, 60 to a request."""
    return R.scan_questions(_units_without_routes(spark, sf_dir), project="demo").select(
        "repo", "id", "batch_no", "q", "instructions")


@query(units_query("""SELECT repo, k // 60 AS batch_no, 'q' || (k % 60) AS q, count(*) OVER (PARTITION BY repo, k // 60) AS questions,
 'To carry out the task in `task`, a developer must read or modify this code unit: ' || label AS question
FROM labelled""", LABEL_SQL))
def scan_batches(spark, sf_dir):
    """Request bodies: the questions each holds, with their text."""
    batches = R.scan_batches(R.scan_questions(_units_without_routes(spark, sf_dir)))
    return batches.select(
        "repo", "batch_no", F.size("questions").cast("bigint").alias("questions"),
        F.explode("questions").alias("q", "question"))


@query("""SELECT CAST(item_id AS varchar) AS task_id, CAST(ceil((SELECT count(*) FROM documents) / 60.0) AS bigint) AS calls
FROM benchmark""")
def scan_calls(spark, sf_dir):
    """Requests of a full scan per task."""
    parts = R.parts(bench_tasks(spark, sf_dir), "none")
    return R.scan_calls(parts, doc_units(spark, sf_dir)).select("task_id", "calls")


ANSWERS_SQL = """answers AS (
 SELECT CAST(b.item_id AS varchar) AS item, d.doc_id AS doc, d.source AS file, l.quality * ((d.doc_id * 7 + b.item_id) % 97) / 97.0 AS p
 FROM labels l CROSS JOIN generate_series(0, 2) j(j)
 JOIN benchmark b ON b.item_id = (l.doc_id * 7 + j * 13) % (SELECT count(*) FROM benchmark)
 JOIN documents d ON d.doc_id = l.doc_id)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given probabilities: every labelled document for three items, chosen by its key."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    n = items.count()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.array(*[
        (F.col("doc_id") * 7 + j * 13) % n for j in range(3)])).alias("item_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    p = F.col("quality") * ((F.col("doc_id") * 7 + F.col("item_id")) % 97) / F.lit(97.0)
    return labels.join(docs, "doc_id").join(items, "item_id").select(
        F.lit("src").alias("repo"), F.col("item_id").cast("string").alias("task_id"),
        F.lit(1).alias("part_no"), F.col("source").alias("file"),
        F.col("doc_id").alias("start"), p.alias("p"))


FULL_SCAN_SQL = f"""WITH {ANSWERS_SQL},
full_scan AS (
 SELECT CAST(b.item_id AS varchar) AS item, d.source AS file, d.doc_id AS doc, coalesce(a.p, 0) AS p
 FROM benchmark b CROSS JOIN documents d LEFT JOIN answers a ON a.item = CAST(b.item_id AS varchar) AND a.doc = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, file, doc) AS rank FROM full_scan)"""


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = R.parts(bench_tasks(spark, sf_dir), "none")
    return R.ranked_scan(parts, doc_units(spark, sf_dir), _answers(spark, sf_dir))


@query(FULL_SCAN_SQL + """ SELECT item AS task_id, rank, file, doc AS doc_id, floor(p * 1000 + 0.5) / 1000 AS p
FROM ranked WHERE rank <= 15""")
def scored_scan(spark, sf_dir):
    """Units of a full scan by given probabilities; unanswered ones count as 0."""
    return _scan(spark, sf_dir)[0].select(
        "task_id", "rank", "file", F.col("start").cast("bigint").alias("doc_id"), "p")


@query(FULL_SCAN_SQL + """, best AS (SELECT item, file, min(rank) AS r, max(p) AS p FROM ranked GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY r) AS rank FROM best)
SELECT item AS task_id, rank, file, floor(p * 1000 + 0.5) / 1000 AS p FROM top WHERE rank <= 10""")
def scored_files(spark, sf_dir):
    """Files of a full scan."""
    return _scan(spark, sf_dir)[1].select("task_id", "rank", "file", "p")


@query(f"WITH {ANSWERS_SQL}, {scores_sql('source', WHOLE_ITEMS)} " """
SELECT s.item AS task_id, s.doc AS doc_id, coalesce(a.p, 0) AS p FROM scored s
LEFT JOIN answers a ON a.item = s.item AND a.doc = s.doc WHERE s.rank <= 40""")
def applied_answers(spark, sf_dir):
    """Given probabilities put on the questions that were asked; 0 when missing."""
    asked = _prefiltered(spark, sf_dir).select(*R.PART_KEY, "file", "start")
    return R.apply_answers(asked, _answers(spark, sf_dir)).select(
        "task_id", F.col("start").cast("bigint").alias("doc_id"), "p")


CHOICE_SQL = """, cands AS (SELECT *, CASE WHEN rank % 7 = 0 OR CAST(item AS bigint) % 4 = 3 THEN NULL ELSE ((rank * 37) % 101) / 101.0 END AS p0
  FROM scored WHERE rank <= 40),
 reranked AS (SELECT item, file, doc, score, coalesce(p0, 0) AS p, row_number() OVER (PARTITION BY item ORDER BY coalesce(p0, 0) DESC, rank) AS rank FROM cands)"""


def _choice_answers(cands: DataFrame) -> DataFrame:
    """Probabilities for most candidates of most tasks, by their keyword rank."""
    p = ((F.col("rank") * 37) % 101) / F.lit(101.0)
    given = cands.where((F.col("rank") % 7 != 0) & (F.col("task_id").cast("bigint") % 4 != 3))
    return given.select(*R.PART_KEY, F.concat(F.lit("u"), F.col("rank").cast("string")).alias("k"),
                        p.alias("p"))


@query(f"WITH {scores_sql('source', WHOLE_ITEMS)} {CHOICE_SQL} "
       "SELECT item AS task_id, rank, file, doc AS doc_id, score, p FROM reranked")
def reranked_choice(spark, sf_dir):
    """Candidates put in the order of answered probabilities; keyword order where equal."""
    cands = saved(_prefiltered(spark, sf_dir), "candidates")
    return R.rerank_choice(cands, _choice_answers(cands)).select(
        "task_id", "rank", "file", F.col("start").cast("bigint").alias("doc_id"), "score", "p")


@query(f"WITH {scores_sql('source', WHOLE_ITEMS)} " """
SELECT s.item AS task_id, 'u' || s.rank AS k, s.file, left(d.text, 220) AS does
FROM scored s JOIN documents d ON d.doc_id = s.doc WHERE s.rank <= 40
UNION ALL SELECT DISTINCT item, 'none', 'None of these units is the right place for the task', NULL FROM scored""")
def choice_criteria(spark, sf_dir):
    """Criteria of the choice question per task: each candidate with its text, and none."""
    units = doc_units(spark, sf_dir)
    criteria = R.choice_criteria(_prefiltered(spark, sf_dir), units)
    entry = criteria.select("task_id", F.explode("criteria").alias("k", "v"))
    plain = F.col("k") == "none"
    return entry.select(
        "task_id", "k", F.when(plain, F.col("v")).otherwise(
            F.get_json_object("v", "$.file")).alias("file"),
        F.when(~plain, F.get_json_object("v", "$.does")).alias("does"))


@query(f"WITH {scores_sql('source', WHOLE_ITEMS)} "
       "SELECT item AS task_id, rank, doc AS doc_id, score, 'keyword order only' AS note FROM scored "
       "WHERE rank <= 40 AND CAST(item AS bigint) % 5 = 0")
def keyword_fallback(spark, sf_dir):
    """Keyword order for the tasks that have no answers."""
    parts = R.parts(bench_tasks(spark, sf_dir), "none")
    answered = parts.where(F.col("task_id").cast("bigint") % 5 != 0)
    index = R.token_index(doc_units(spark, sf_dir))
    return R.keyword_fallback(parts, answered, index).select(
        "task_id", "rank", F.col("start").cast("bigint").alias("doc_id"), "score", "note")


SEGMENT_PARTS = (
    "parts AS (SELECT CAST(c_custkey AS varchar) AS item, 1 AS part_no, lower(c_mktsegment) || ' ' || c_name AS part FROM customer)"
)


@query(f"WITH {scores_sql('source', SEGMENT_PARTS)} "
       "SELECT item AS task_id, part AS task FROM parts WHERE item NOT IN (SELECT item FROM scored)")
def no_candidates(spark, sf_dir):
    """Customers whose segment and name share no keyword with any document."""
    text = F.concat_ws(" ", F.lower("c_mktsegment"), "c_name")
    tasks = table(spark, sf_dir, "customer").select(
        F.lit("src").alias("repo"), F.col("c_custkey").cast("string").alias("task_id"),
        text.alias("text"))
    parts = R.parts(tasks, "none")
    lost = R.parts_without_candidates(parts, R.token_index(doc_units(spark, sf_dir)))
    return lost.select("task_id", F.col("part").alias("task"))


@query(f"""WITH pairs AS (SELECT u.conv_id, u.turn, u.text AS asked, coalesce(a.text, '') AS said
  FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user') u
  JOIN (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
 numbered AS (SELECT *, row_number() OVER () AS r FROM pairs),
 asked_words AS (SELECT DISTINCT r, unnest({tokens("coalesce(asked, '')")}) AS word FROM numbered),
 said_words AS (SELECT DISTINCT r, unnest({tokens("said")}) AS word FROM numbered),
 vocab AS (SELECT word FROM asked_words UNION SELECT word FROM said_words),
 {stem_ctes("vocab")},
 asked_stems AS (SELECT DISTINCT r, stem FROM asked_words JOIN stems USING (word)),
 said_stems AS (SELECT DISTINCT r, stem FROM said_words JOIN stems USING (word)),
 shared AS (SELECT r, count(*) AS n FROM asked_stems JOIN said_stems USING (r, stem) GROUP BY r)
SELECT conv_id, turn, coalesce(n, 0) AS score FROM numbered LEFT JOIN shared USING (r)""")
def answer_scores(spark, sf_dir):
    """How many stems of a user's turn the answer to it takes up."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'").distinct().select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("asked"))
    said = turns.where("role = 'assistant'").distinct().select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("said"))
    return asked.join(said, ["conv_id", "turn"]).select(
        "conv_id", "turn", T.keyword_score(F.col("said"), F.col("asked")).cast("bigint").alias("score"))


# --------------------------------------------------------------- searches, end to end

FIND_TASKS = """SELECT CAST(item_id AS varchar) AS id, text FROM benchmark
 UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation"""
FIND_SQL = f"""WITH {scores_sql('source', split_ctes(FIND_TASKS, "split_") + ", parts AS (SELECT id AS item, part_no, part FROM split_parts)")}
{RANKED_FILES},
 asked AS (SELECT *, EXISTS (SELECT 1 FROM scored s WHERE s.item = p.item AND s.part_no = p.part_no) AS has_any,
  part_no % 3 > 0 AS answered FROM parts p)"""


def _find_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.lit("src").alias("repo"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
        .alias("task_id"), F.col("n_name").alias("text"))
    return bench_tasks(spark, sf_dir).unionByName(nations)


def _find_usage(parts: DataFrame) -> DataFrame:
    return parts.select(*R.PART_KEY, (F.length("part") * 10).cast("bigint").alias("tokens"))


def _find_prefilter(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two parts of three are answered: a probability for most candidates by their keyword
    rank, a confidence and a probability of none by the number of the part."""
    tasks, units = _find_tasks(spark, sf_dir), doc_units(spark, sf_dir)
    index = saved(R.token_index(units), "stems")
    parts = R.parts(tasks)
    asked = parts.where(F.col("part_no") % 3 > 0)
    cands = saved(R.prefilter(asked, index), "candidates", plain=True).where(F.col("rank") % 7 != 0)
    by_rank = cands.select(
        *R.PART_KEY, F.concat(F.lit("u"), F.col("rank").cast("string")).alias("k"),
        (((F.col("rank") * 37) % 101) / F.lit(101.0)).alias("p"))
    more = [asked.select(*R.PART_KEY, F.lit(k).alias("k"), p.alias("p")) for k, p in (
        ("none", F.lit(1.0) / (F.col("part_no") + 2)), ("confidence", F.col("part_no") / F.lit(64.0)))]
    answers = by_rank.unionByName(more[0]).unionByName(more[1])
    return find(tasks, units, mode="prefilter", answers=answers, usage=_find_usage(parts), index=index)


@query(FIND_SQL + """ SELECT item AS task_id, part_no, part,
 CASE WHEN NOT has_any THEN 'No unit shares a keyword with the task' WHEN NOT answered THEN 'keyword order only' END AS note,
 CASE WHEN has_any AND answered THEN 1 ELSE 0 END::bigint AS calls,
 CASE WHEN has_any AND answered THEN length(part) * 10 ELSE 0 END::bigint AS tokens,
 CASE WHEN has_any AND answered THEN floor(length(part) * 10 / 1e6 * 0.042 * 1e6 + 0.5) / 1e6 ELSE 0 END AS cost_usd,
 CASE WHEN has_any AND answered THEN part_no / 64.0 END AS confidence,
 CASE WHEN has_any AND answered THEN floor(1.0 / (part_no + 2) * 1000 + 0.5) / 1000 END AS none FROM asked""")
def find_prefilter(spark, sf_dir):
    """Parts of a search among candidates: how each was ranked and what it took."""
    return _find_prefilter(spark, sf_dir)["parts"].select(
        "task_id", F.col("part_no").cast("bigint").alias("part_no"), "part", "note", "calls",
        "tokens", "cost_usd", "confidence", "none")


@query(FIND_SQL + """, cands AS (SELECT *, CASE WHEN rank % 7 = 0 THEN 0 ELSE ((rank * 37) % 101) / 101.0 END AS p0
  FROM scored WHERE rank <= 40),
 placed AS (SELECT item, part_no, file, doc, score, CASE WHEN part_no % 3 > 0 THEN floor(p0 * 1000 + 0.5) / 1000 END AS p,
  row_number() OVER (PARTITION BY item, part_no ORDER BY CASE WHEN part_no % 3 > 0 THEN p0 ELSE 0 END DESC, rank) AS rank FROM cands)
SELECT item AS task_id, part_no, rank, file, doc AS doc_id, left(d.text, 120) AS description, score, p
FROM placed JOIN documents d ON d.doc_id = placed.doc WHERE rank <= 15""")
def find_prefilter_units(spark, sf_dir):
    """The best units of that search."""
    return _find_prefilter(spark, sf_dir)["units"].select(
        "task_id", F.col("part_no").cast("bigint").alias("part_no"), "rank", "file",
        F.col("line").alias("doc_id"), "description", "score", "p")


def _find_scan(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tasks, units = _find_tasks(spark, sf_dir), doc_units(spark, sf_dir)
    return find(tasks, units, answers=_answers(spark, sf_dir), usage=_find_usage(R.parts(tasks)))


SCANNED_SQL = FIND_SQL + f""", {ANSWERS_SQL},
 reached AS (SELECT p.*, p.part_no = 1 AND EXISTS (SELECT 1 FROM answers a WHERE a.item = p.item) AS given FROM parts p)"""


@query(SCANNED_SQL + """ SELECT item AS task_id, part_no, CASE WHEN NOT given THEN 'keyword order only' END AS note,
 CASE WHEN given THEN CAST(ceil((SELECT count(*) FROM documents) / 60.0) AS bigint) ELSE 0 END AS calls,
 CASE WHEN given THEN length(part) * 10 ELSE 0 END::bigint AS tokens,
 CASE WHEN given THEN floor(length(part) * 10 / 1e6 * 0.042 * 1e6 + 0.5) / 1e6 ELSE 0 END AS cost_usd FROM reached""")
def find_scan(spark, sf_dir):
    """Parts of a full scan: how each was ranked and what it took."""
    return _find_scan(spark, sf_dir)["parts"].select(
        "task_id", F.col("part_no").cast("bigint").alias("part_no"), "note", "calls", "tokens",
        "cost_usd")


@query(SCANNED_SQL + """, full_scan AS (SELECT r.item, d.source AS file, d.doc_id AS doc, coalesce(a.p, 0) AS p
  FROM reached r CROSS JOIN documents d LEFT JOIN answers a ON a.item = r.item AND a.doc = d.doc_id WHERE r.given),
 placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, file, doc) AS rank FROM full_scan),
 best AS (SELECT item, file, min(rank) AS r, max(p) AS p FROM placed GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY r) AS rank FROM best)
SELECT item AS task_id, 1 AS part_no, rank, file, NULL AS score, floor(p * 1000 + 0.5) / 1000 AS p FROM top WHERE rank <= 10
UNION ALL SELECT f.item, f.part_no, f.rank, f.file, f.score, NULL FROM files_ranked f JOIN reached r USING (item, part_no)
 WHERE NOT r.given AND f.rank <= 10""")
def find_scan_files(spark, sf_dir):
    """The best files of that scan; keyword order where there are no answers."""
    return _find_scan(spark, sf_dir)["files"].select(
        "task_id", F.col("part_no").cast("bigint").alias("part_no"), "rank", "file", "score", "p")


@query(f"WITH {split_ctes(TURNS)} " """
SELECT id AS task_id, count(*) AS calls, CAST(sum(length(part)) AS bigint) AS tokens,
 floor(sum(floor(length(part) / 1e6 * 0.042 * 1e6 + 0.5) / 1e6) * 1e6 + 0.5) / 1e6 AS cost_usd
FROM parts GROUP BY ALL""")
def task_cost(spark, sf_dir):
    """Price per task when every part costs a token per character."""
    usage = R.parts(_turns(spark, sf_dir)).withColumn("tokens", F.length("part").cast("bigint"))
    return R.task_cost(usage).select("task_id", "calls", "tokens", "cost_usd")


# --------------------------------------------------------------- evaluation

BENCH_ITEMS = "SELECT CAST(item_id AS varchar) AS id, text FROM benchmark"
TRUTH_SQL = """, doc_list AS (SELECT doc_id, source || '/' || doc_id AS file, [w FOR w IN regexp_split_to_array(text, '\\s+') IF w <> ''] AS ws FROM documents),
 grams AS (SELECT file, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT file, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM doc_list)),
 items AS (SELECT CAST(item_id AS varchar) AS item, [w FOR w IN regexp_split_to_array(text, '\\s+') IF w <> ''] AS ws FROM benchmark),
 wanted AS (SELECT DISTINCT item, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT item, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM items)),
 targets AS (SELECT DISTINCT item, file FROM wanted JOIN grams USING (g))"""
BENCH_SQL = f"""WITH {scores_sql("source || '/' || doc_id", split_ctes(BENCH_ITEMS, "split_") + ", parts AS (SELECT id AS item, part_no, part FROM split_parts)")}
{RANKED_FILES} {TRUTH_SQL},
 proposed AS (SELECT item, file, part_no, rank FROM files_ranked WHERE rank <= 10),
 firsts AS (SELECT item, file, min(part_no * 100 + rank) AS place, min(rank) AS best FROM proposed GROUP BY ALL),
 union_ranked AS (SELECT item, file, best, row_number() OVER (PARTITION BY item ORDER BY place) AS rank FROM firsts),
 counts AS (SELECT item, count(*) AS parts FROM parts GROUP BY ALL),
 bench_rows AS (SELECT t.item AS task_id, any_value(c.parts) AS parts, coalesce(min(u.rank), 0) AS rank,
  floor(count(*) FILTER (u.best <= 1) / count(*) * 1000 + 0.5) / 1000 AS coverage1,
  floor(count(*) FILTER (u.best <= 3) / count(*) * 1000 + 0.5) / 1000 AS coverage3
  FROM targets t JOIN counts c USING (item) LEFT JOIN union_ranked u USING (item, file) GROUP BY ALL)"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: documents that hold eight words in a row of an item. Hashes of the fragments are
    compared first, and the texts of the few documents that match are looked at again."""
    def words(c: str):
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def each(ws: str, make):
        return F.when(F.size(ws) >= 8, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - 7), make)))

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.element_at("ws", i + k) for k in range(8)])

    # Short texts have no fragments. A filter for them would move in front of the dealing out.
    docs = dealt(table(spark, sf_dir, "documents"), ROWS_PER_TASK).select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"),
        words("text").alias("ws"))
    wanted = saved(table(spark, sf_dir, "benchmark").select(
        F.lit("src").alias("repo"), F.col("item_id").cast("string").alias("task_id"),
        words("text").alias("ws")).select(
        "repo", "task_id", F.explode(each("ws", lambda i: F.struct(
            F.array_join(F.slice("ws", i, 8), " ").alias("g"), hashed(i).alias("h")))).alias("w"))
        .select("repo", "task_id", "w.*"), "fragments")
    hashes = docs.select("file", F.explode(each("ws", hashed)).alias("h"))
    maybe = saved(hashes.join(wanted, "h"), "maybe")
    texts = docs.select("file", F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")).alias("t"))
    holds = F.contains(F.col("t"), F.concat(F.lit(" "), F.col("g"), F.lit(" ")))
    return texts.join(maybe, "file").where(holds).select("repo", "task_id", "file").distinct()


def _bench_usage(parts: DataFrame) -> DataFrame:
    """What the searches took: a call per part, tokens by length, no price; some failed."""
    failed = F.col("task_id").cast("bigint") % 10 == 4
    return parts.groupBy("repo", "task_id").agg(
        F.count("*").alias("calls"), F.sum(F.length("part").cast("bigint") * 3).alias("tokens")
    ).select("*", F.lit(0.0).alias("cost_usd"), F.when(failed, "no answer").alias("error"))


def _bench_rows(spark: SparkSession, sf_dir: str, used: bool = False) -> DataFrame:
    targets = saved(_truth(spark, sf_dir), "targets")
    tasks = bench_tasks(spark, sf_dir).join(targets.select("repo", "task_id"),
                                            ["repo", "task_id"], "left_semi")
    parts = R.parts(tasks)
    index = R.token_index(doc_units(spark, sf_dir, one_file_each=True))
    ranked = saved(R.rank_files(R.prefilter(parts, index), by="score"), "ranked")
    return E.bench_rows(ranked, targets, parts, "prefilter", _bench_usage(parts) if used else None)


@query(BENCH_SQL + " SELECT task_id, 'prefilter' AS mode, parts, rank, coverage1, coverage3 FROM bench_rows")
def hit_ranks(spark, sf_dir):
    """Rank of the first hit and coverage per benchmark item."""
    return _bench_rows(spark, sf_dir).select(
        "task_id", "mode", "parts", F.col("rank").cast("bigint").alias("rank"), "coverage1",
        "coverage3")


@query(BENCH_SQL + """ SELECT 'prefilter' AS mode, count(*) AS commits,
 CAST(floor(100 * count(*) FILTER (rank BETWEEN 1 AND 1) / count(*) + 0.5) AS integer) AS top1,
 CAST(floor(100 * count(*) FILTER (rank BETWEEN 1 AND 3) / count(*) + 0.5) AS integer) AS top3,
 CAST(floor(100 * count(*) FILTER (rank BETWEEN 1 AND 5) / count(*) + 0.5) AS integer) AS top5,
 CAST(floor(100 * avg(coverage3) + 0.5) AS integer) AS coverage_top3 FROM bench_rows""")
def hit_rate(spark, sf_dir):
    """Share of items with a hit in the first 1, 3 and 5 files."""
    return E.bench_summary(_bench_rows(spark, sf_dir)).select(
        "mode", "commits", "top1", "top3", "top5", "coverage_top3")


SPENT_SQL = """, spent AS (SELECT item, count(*) AS calls, sum(length(part) * 3)::bigint AS tokens FROM parts GROUP BY ALL),
 n_targets AS (SELECT item, count(*) AS targets FROM targets GROUP BY ALL),
 full_rows AS (SELECT task_id, targets, CAST(task_id AS bigint) % 10 <> 4 AS ok, parts, rank, coverage1, coverage3, calls, tokens,
  floor(tokens / 1e6 * 0.042 * 1e6 + 0.5) / 1e6 AS cost_usd
  FROM bench_rows b JOIN spent s ON s.item = b.task_id JOIN n_targets n ON n.item = b.task_id)"""


@query(BENCH_SQL + SPENT_SQL + """ SELECT task_id, targets, CASE WHEN ok THEN parts ELSE 0 END AS parts, CASE WHEN ok THEN rank ELSE 0 END AS rank,
 CASE WHEN ok THEN coverage1 ELSE 0 END AS coverage1, CASE WHEN ok THEN coverage3 ELSE 0 END AS coverage3,
 CASE WHEN ok THEN calls ELSE 0 END AS calls, CASE WHEN ok THEN tokens ELSE 0 END AS tokens,
 CASE WHEN ok THEN cost_usd ELSE 0 END AS cost_usd, CASE WHEN NOT ok THEN 'no answer' END AS error FROM full_rows""")
def bench_table(spark, sf_dir):
    """Evaluation rows with targets, calls, tokens, prices from tokens, and failed searches."""
    return _bench_rows(spark, sf_dir, True).select(
        "task_id", "targets", "parts", F.col("rank").cast("bigint").alias("rank"), "coverage1",
        "coverage3", "calls", "tokens", "cost_usd", "error")


@query(BENCH_SQL + SPENT_SQL + """ SELECT count(*) AS commits,
 CAST(floor(100 * count(*) FILTER (ok AND rank = 1) / count(*) + 0.5) AS integer) AS top1,
 floor(avg(CASE WHEN ok THEN calls ELSE 0 END) * 10 + 0.5) / 10 AS calls,
 CAST(floor(avg(CASE WHEN ok THEN tokens ELSE 0 END) + 0.5) AS bigint) AS tokens,
 floor(sum(CASE WHEN ok THEN cost_usd ELSE 0 END) * 1e4 + 0.5) / 1e4 AS cost_usd,
 count(*) FILTER (NOT ok) AS errors FROM full_rows""")
def bench_totals(spark, sf_dir):
    """Their summary: hits, mean calls and tokens, total price, errors."""
    return E.bench_summary(_bench_rows(spark, sf_dir, True)).select(
        "commits", "top1", "calls", "tokens", "cost_usd", "errors")


def _log_sql(agg: str, lineitem: str, part: str, orders: str) -> str:
    """Blocks of a commit log: an order is a commit, its parts are the touched files."""
    return f"""
SELECT concat(CAST(o_orderkey AS varchar(20)), ' |', CASE WHEN o_orderkey % 10 = 0 THEN 'Merge branch ' WHEN o_orderkey % 10 = 1 THEN 'wip ' ELSE 'feat: change ' END,
  CASE WHEN o_orderkey % 10 = 1 THEN '' ELSE concat('stock  of order ', o_orderpriority) END, '|first', chr(10),
  CASE WHEN o_orderkey % 3 = 0 THEN concat('Signed-off-by: ', o_orderstatus, chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('some more text', chr(10), 'word', chr(10)) ELSE chr(10) END,
  paths, chr(10), chr(10)) AS block
FROM {orders} JOIN (
 SELECT l_orderkey, {agg} AS paths FROM (
  SELECT l_orderkey, concat(replace(lower(p_brand), '#', ''), '/f', CAST(p_partkey AS varchar(20)),
   CASE WHEN p_size = 47 THEN '.txt' WHEN p_partkey % 4 = 0 THEN '.py' WHEN p_partkey % 4 = 1 THEN '.js' WHEN p_partkey % 4 = 2 THEN '.rb' ELSE '.sql' END) AS path
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) x GROUP BY l_orderkey) t ON l_orderkey = o_orderkey"""


COMMITS_SQL = f"""blocks AS ({_log_sql("string_agg(path, chr(10) ORDER BY path)", "lineitem", "part", "orders")}),
split AS (SELECT trim(split_part(head, '|', 1)) AS hash, trim(split_part(head, '|', 2)) AS subject, split_part(head, '|', 3) AS first, ls
 FROM (SELECT string_split(block, chr(10))[1] AS head, string_split(block, chr(10))[2:] AS ls FROM blocks)),
rows AS (SELECT hash, subject, first, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
lasts AS (SELECT hash, max(i) FILTER (trim(line) <> '') AS last FROM rows GROUP BY ALL),
starts AS (SELECT r.hash, l.last, coalesce(max(i) FILTER (NOT regexp_matches(trim(line), '^\\S+$')), 0) AS stop
 FROM rows r JOIN lasts l USING (hash) WHERE i <= last GROUP BY r.hash, l.last),
touched AS (SELECT DISTINCT r.hash, trim(line) AS path FROM rows r JOIN starts s USING (hash) WHERE i > stop AND i <= last),
bodies AS (SELECT r.hash, string_agg(trim(line), ' ' ORDER BY i) AS body FROM rows r JOIN starts s USING (hash)
 WHERE i <= stop AND trim(line) <> '' AND NOT regexp_matches(trim(line), '(?i)^(co-authored-by|signed-off-by|reviewed-by|refs?|fixes):') GROUP BY ALL),
usable AS (SELECT hash, task FROM (
  SELECT s.hash, subject, trim(regexp_replace(concat_ws(' ', subject, trim(first), body), '\\s+', ' ', 'g')) AS task FROM split s LEFT JOIN bodies b USING (hash))
 WHERE NOT regexp_matches(subject, '(?i)^merge\\b') AND length(task) >= 15),
targets AS (SELECT t.hash, t.path FROM touched t JOIN usable USING (hash) JOIN (SELECT DISTINCT path FROM chosen) c USING (path)
 WHERE NOT regexp_matches(t.path, '[.](md|markdown|rst|txt|json|yml|yaml|lock|toml|ini|cfg)$'))"""


def commit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _log_sql("array_join(array_sort(collect_list(path)), chr(10))",
                   "{lineitem}", "{part}", "{orders}")
    # An order is few bytes of Parquet and many more in memory: sizes of files must not choose a broadcast.
    named = {t: table(spark, sf_dir, t).hint("merge") for t in ("lineitem", "part", "orders")}
    return spark.sql(sql, **named).select(F.lit("all").alias("repo"), "block")


@query(files_query("SELECT hash, task, path FROM targets JOIN usable USING (hash)", COMMITS_SQL))
def commit_targets(spark, sf_dir):
    """Usable commits of a log derived from orders, with the source files they touched."""
    commits = saved(E.usable_commits(E.parse_commits(commit_blocks(spark, sf_dir))), "commits")
    known = scanned(code_files(spark, sf_dir), unique=True).select(
        F.lit("all").alias("repo"), F.col("path").alias("file"))
    touched = E.touched_in_map(E.target_filter(E.touched_files(commits)), known)
    return touched.join(commits, ["repo", "hash"]).select("hash", "task", "path")


# --------------------------------------------------------------- searches and evaluation over code

def unit_scores_sql(parts: str) -> str:
    """CTEs ending in ranked_units(repo, item, part_no, file, start, score, rank) for the unit table
    and a CTE parts(repo, item, part_no, part). Equal texts of a repository are scored once."""
    return f"""
{parts},
unit_texts AS (
  SELECT repo, file, first_line AS start,
    {tokens("concat_ws(' ', id, name, file, area, nullif(comment, ''), path, route, parent, array_to_string(tables, ' '), array_to_string(calls, ' '), array_to_string(emits, ' '))")} AS ws,
    {tokens("concat_ws(' ', name, file, path, route)")} AS ns
  FROM units
),
unit_words AS (SELECT DISTINCT repo, file, start, unnest(ws) AS word FROM unit_texts),
unit_names AS (SELECT DISTINCT repo, file, start, unnest(ns) AS word FROM unit_texts),
texts AS (SELECT DISTINCT repo, part FROM parts),
text_words AS (SELECT DISTINCT repo, part, unnest({tokens("part")}) AS word FROM texts),
vocab AS (SELECT word FROM unit_words UNION SELECT word FROM text_words),
{stem_ctes("vocab")},
unit_stems AS (SELECT DISTINCT repo, file, start, stem FROM unit_words JOIN stems USING (word)),
unit_name_stems AS (SELECT DISTINCT repo, file, start, stem, true AS named FROM unit_names JOIN stems USING (word)),
text_stems AS (SELECT DISTINCT repo, part, stem FROM text_words JOIN stems USING (word)),
text_scores AS (
  SELECT t.repo, t.part, u.file, u.start, CAST(sum(CASE WHEN n.named THEN 1.5 ELSE 1.0 END) AS double) AS score
  FROM text_stems t JOIN unit_stems u USING (repo, stem) LEFT JOIN unit_name_stems n USING (repo, file, start, stem)
  GROUP BY ALL
),
text_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY repo, part ORDER BY score DESC, file, start) AS rank FROM text_scores
),
ranked_units AS (SELECT p.item, p.part_no, r.* FROM parts p JOIN text_ranks r USING (repo, part) WHERE rank <= 40)"""


MIXED_TASKS = """SELECT concat('r', CAST(p_partkey % 25 AS varchar(20)), '/', CAST(p_partkey AS varchar(20))) AS id,
 concat('List ', p_name, ' of customers; then read the stock of ', replace(lower(p_type), ' ', '_'), ' by id') AS text FROM part"""


@query(units_query("""SELECT split_part(item, '/', 2) AS task_id, repo, part_no, rank, r.file, u.id, u.name, start AS line,
 left(u.comment, 120) AS description, score
FROM ranked_units r JOIN units u USING (repo, file) WHERE u.first_line = start AND rank <= 15""",
    unit_scores_sql(split_ctes(MIXED_TASKS, "split_")
                    + ", parts AS (SELECT split_part(id, '/', 1) AS repo, id AS item, part_no, part FROM split_parts)")))
def find_mixed(spark, sf_dir):
    """Keyword search over mined units: names, paths, routes, parents, tables, calls and events of
    endpoints, pages, classes and jobs, for two-part tasks of every part."""
    units, _ = code_map(spark, sf_dir)
    task = spark.sql(MIXED_TASKS.replace("FROM part", "FROM {part}"), part=spread(table(spark, sf_dir, "part")))
    at = F.split("id", "/")
    tasks = task.select(F.get(at, F.lit(0)).alias("repo"), F.get(at, F.lit(1)).alias("task_id"), "text")
    found = find(tasks, saved(units, "units"), mode="prefilter")
    return found["units"].select(
        "task_id", "repo", F.col("part_no").cast("bigint").alias("part_no"),
        F.col("rank").cast("bigint").alias("rank"), "file", "id", "name", "line", "description", "score")


LOG_BENCH_SQL = f"""{COMMITS_SQL.replace("bodies", "commit_bodies").replace("rows AS", "log_rows AS").replace("FROM rows ", "FROM log_rows ")},
 tasks AS (SELECT hash AS item, task FROM usable WHERE hash IN (SELECT hash FROM targets)),
{unit_scores_sql("parts AS (SELECT 'all' AS repo, item, 1 AS part_no, task AS part FROM tasks)").replace("FROM units\n", "FROM (SELECT * REPLACE ('all' AS repo) FROM units)\n")},
 by_file AS (SELECT item, file, max(score) AS score, min(rank) AS r FROM ranked_units GROUP BY ALL),
 keyword_files AS (SELECT item, file, row_number() OVER (PARTITION BY item ORDER BY r) AS rank FROM by_file),
 map_files AS (SELECT file, row_number() OVER (ORDER BY file) AS n FROM (SELECT DISTINCT file FROM units)),
 given AS (SELECT hash AS item, min(path) AS file FROM targets WHERE CAST(hash AS bigint) % 3 = 0 GROUP BY ALL),
 scan_files AS (SELECT item, file, 1 AS rank FROM given
  UNION ALL SELECT item, f, 1 + row_number() OVER (PARTITION BY item ORDER BY n) FROM (
   SELECT g.item, m.file AS f, n FROM given g JOIN map_files m ON m.n <= 11 AND m.file <> g.file)),
 proposed AS (SELECT 'prefilter' AS mode, item, file, rank FROM keyword_files
  UNION ALL SELECT 'scan', item, file, rank FROM keyword_files WHERE item NOT IN (SELECT item FROM given)
  UNION ALL SELECT 'scan', item, file, rank FROM scan_files),
 log_bench AS (SELECT m.mode, t.hash AS task_id, count(*) AS targets, coalesce(min(p.rank), 0) AS rank,
   floor(count(*) FILTER (p.rank <= 1) / count(*) * 1000 + 0.5) / 1000 AS coverage1,
   floor(count(*) FILTER (p.rank <= 3) / count(*) * 1000 + 0.5) / 1000 AS coverage3
  FROM targets t CROSS JOIN (SELECT unnest(['prefilter', 'scan']) AS mode) m
  LEFT JOIN (SELECT * FROM proposed WHERE rank <= 10) p ON p.mode = m.mode AND p.item = t.hash AND p.file = t.path GROUP BY ALL)"""


def _log_bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log as files, one of each task that wrote it, read record by record, and both modes over the units of
    all repositories: a scan with an answer for one file of every third commit, and keyword order."""
    mapped, _ = code_map(spark, sf_dir)
    units = saved(mapped.withColumn("repo", F.lit("all")), "units", plain=True)
    path = f"{shared_folder(spark)}/codelode/log-{uuid.uuid4().hex}"
    commit_blocks(spark, sf_dir).select("block").write.options(lineSep="\n@@", compression="gzip").text(path)
    blocks = E.read_commit_log(spark, path, "all")
    files = units.select("repo", "file").distinct()
    first = units.groupBy("repo", "file").agg(F.min("start").alias("start"))

    def answers(targets: DataFrame) -> DataFrame:
        asked = targets.where(F.col("task_id").cast("bigint") % 3 == 0).select(
            "repo", "task_id", F.array_min("files").alias("file"))
        return asked.join(first, ["repo", "file"]).select(
            "repo", "task_id", F.lit(1).alias("part_no"), "file", "start", F.lit(0.9).alias("p"))

    return bench(blocks, units, files, split="none", answers={"prefilter": None, "scan": answers})


@query(units_query("SELECT mode, task_id, targets, rank, coverage1, coverage3 FROM log_bench", LOG_BENCH_SQL))
def bench_log(spark, sf_dir):
    """Evaluation rows of a commit log, per commit and mode."""
    return _log_bench(spark, sf_dir)[0].select(
        "mode", "task_id", "targets", F.col("rank").cast("bigint").alias("rank"), "coverage1", "coverage3")


@query(units_query("""SELECT mode, count(*) AS commits,
 CAST(floor(100 * count(*) FILTER (rank = 1) / count(*) + 0.5) AS integer) AS top1,
 CAST(floor(100 * count(*) FILTER (rank BETWEEN 1 AND 5) / count(*) + 0.5) AS integer) AS top5,
 CAST(floor(100 * avg(coverage3) + 0.5) AS integer) AS coverage_top3 FROM log_bench GROUP BY ALL""", LOG_BENCH_SQL))
def bench_log_summary(spark, sf_dir):
    """Their summary per mode."""
    return _log_bench(spark, sf_dir)[1].select("mode", "commits", "top1", "top5", "coverage_top3")
