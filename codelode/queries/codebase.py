"""A codebase derived from the ``part`` table, in SQL that Spark and other engines read alike.

Every part becomes one source file (Python, JavaScript, Ruby or SQL, by its key) whose
definitions, comments, routes and SQL strings depend on the name, size and key of the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.sources.scratch import spread


def _line(text: str) -> str:
    """SQL for one line of source: {fn}, {cls}, {tbl}, {k}, {sz}, {name} are filled in."""
    out, rest = [], text
    names = ("fn", "cls", "tbl", "k", "sz", "name")
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in names if "{" + n + "}" in rest]
        if not spots:
            out.append("'" + rest.replace("'", "''") + "'")
            break
        at, n = min(spots)
        if at:
            out.append("'" + rest[:at].replace("'", "''") + "'")
        out.append(n)
        rest = rest[at + len(n) + 2:]
    # A dollar sign before a brace would be read as a variable by Spark SQL.
    out = [part.replace("${", "$', '{") for part in out]
    return ", ".join([*out, "chr(10)"])


def _source(blocks: list[tuple[str, str]]) -> str:
    """SQL concat of blocks of lines; a block with a condition is present only where it
    holds."""
    parts = []
    for condition, text in blocks:
        sql = "concat(" + ", ".join(_line(x) for x in text.removeprefix("\n").removesuffix("\n").split("\n")) + ")"
        parts.append(sql if not condition else f"CASE WHEN {condition} THEN {sql} ELSE '' END")
    return "concat(" + ",\n ".join(parts) + ")"


PYTHON = _source([
    ("n % 3 = 0", '"""Parts of {name}."""'),
    ("n % 3 = 1", "# Stock of {name}.\n# ------\n# Second line."),
    ("", "from .db import db\n"),
    ("n % 5 = 0", "@app.route('/parts/{k}', methods=['GET', 'POST'])"),
    ("n % 5 = 1", "@router.get('/stock/{fn}')\n# A note between."),
    ("n % 5 = 2", "# Above {name}."),
    ("", "def {fn}_{k}(rows):"),
    ("n % 2 = 0", '    """Read {name}."""'),
    ("n % 4 < 3", "    return db.execute('SELECT * FROM {tbl} JOIN totals ON 1 = 1')"),
    ("n % 4 = 3", "    return rows"),
    ("g % 3 = 0", """

# Holder of {name}.
class {cls}:
    def put(self, x):
        def inner():
            pass
        self.rows.append(x)

    @property
    def size(self):
        '''
        Number of {name}.
        '''
        return 1
"""),
    ("n % 7 = 0", "\n@celery.task\ndef nightly():\n    pass"),
    ("n % 7 = 1", "\n@celery.task\nx = 1\ndef plain():\n    pass"),
])
JAVASCRIPT = _source([
    ("n % 3 < 2", "// Stock of {name}."),
    ("", "const db = require('./db');\n"),
    ("n % 2 = 0", "/**\n * Read {name}.\n * @param id\n */"),
    ("", """
export async function read{cls}(id = {}) {
  const pick = (r) => r;
  const rows = await db.query("SELECT * FROM {tbl} WHERE note = '}'"); // {
  return rows;
}
"""),
    ("n % 5 < 3", """

// List {name}.
router.get('/api/{fn}/:id', auth, async (req, res) => {
  io.emit('{fn}-read', 1);
  res.json(1);
});
"""),
    ("n % 4 = 1", """

class {cls} {
  // Put one.
  put(x) {
    const inner = () => 1;
    this.x = x;
  }

  load = async (id) => {
    return db.get(id);
  };
}
"""),
    ("n % 4 = 2", """

const {cls}List = () => {
  axios.get(`${BASE}/api/{fn}/${id}`);
  fetch('/api/{fn}/{k}?full=1');
  return <Table rows={rows} />;
};
"""),
    ("n % 4 = 3", """

const App{k} = () => (
  <Route path="/{fn}/{k}" component={{cls}List} />
);
"""),
    ("n % 6 = 0", "\ncron.schedule('0 4 * * {sz}', () => {\n  sweep();\n});"),
])
RUBY = _source([
    ("n % 2 = 0", "# Stock of {name}."),
    ("n % 3 > 0", """
class {cls} < Base
  # Read it.
  def read_{fn}
    if x
      rows
    end
  end

  def self.find(e)
    db.query("SELECT * FROM {tbl}")
  end
end
"""),
    ("n % 4 = 0", "get '/{fn}/{k}' do\n  'ok'\nend"),
    ("", "\n# Top of {name}.\ndef top_{k}\n  1\nend"),
])
SQL = _source([
    ("n % 2 = 0", "-- Table of {name}."),
    ("", """
CREATE TABLE IF NOT EXISTS {fn}_{k} (
  id INT PRIMARY KEY, -- key; id
  note TEXT DEFAULT ';'
);
"""),
    ("n % 3 = 0", """

/* View of {name}.
   Only one row. */
CREATE OR REPLACE VIEW v_{fn} AS
SELECT * FROM {tbl}
WHERE id = 1;
"""),
])
PLAIN = _source([("", "# Values of {name}.\n# Kept here.\n\nvalue = {k}")])
PACKED = "concat('function a() { ', repeat('x', 2500), ' }', chr(10))"

CODE_FILES_SQL = f"""
SELECT repo, path, text, CAST(length(text) AS bigint) AS size FROM (
 SELECT repo, path, CASE WHEN n % 10 = 9 THEN replace(body, chr(10), concat(chr(13), chr(10))) ELSE body END AS text
 FROM (
  SELECT concat('r', CAST(pk % 25 AS varchar(20))) AS repo,
   concat(CASE WHEN n = 48 THEN 'node_modules/' ELSE '' END, folder, '/f', k,
    CASE WHEN n = 47 THEN '.txt' WHEN pk % 4 = 0 THEN '.py' WHEN pk % 4 = 1 THEN '.js' WHEN pk % 4 = 2 THEN '.rb' ELSE '.sql' END) AS path,
   CASE WHEN n = 49 THEN {PACKED}
    WHEN n = 50 THEN {PLAIN}
    WHEN pk % 4 = 0 THEN {PYTHON}
    WHEN pk % 4 = 1 THEN {JAVASCRIPT}
    WHEN pk % 4 = 2 THEN {RUBY}
    ELSE {SQL} END AS body, n
  FROM (
   SELECT p_partkey AS pk, CAST(p_partkey AS varchar(20)) AS k, p_size AS n, CAST(p_size AS varchar(20)) AS sz,
    CAST((p_partkey - p_partkey % 4) / 4 AS bigint) AS g,
    replace(lower(p_brand), '#', '') AS folder, p_name AS name, replace(p_name, ' ', '_') AS fn,
    concat(upper(substring(p_name, 1, 1)), replace(substring(p_name, 2, 100), ' ', '')) AS cls,
    CASE p_partkey % 3 WHEN 0 THEN 'customers' WHEN 1 THEN 'nation_rates' ELSE 'lot' END AS tbl
   FROM part
  ) a
 ) b
) c
"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, text, size)."""
    sql = CODE_FILES_SQL.replace("{", "{{").replace("}", "}}").replace("FROM part\n", "FROM {part}\n")
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    return spark.sql(sql, part=part)
