import pytest
from pyspark.sql import functions as F

from codelode.operators import describe as D
from codelode.plans.build import build_map
from codelode.sources import mapstore as M

FILES = {
    "srv/orders.js": """\
// Orders: list and close.
const db = require('./db');

// List the orders.
router.get('/api/orders', auth, async (req, res) => {
  res.json(await db.query('SELECT * FROM shop_orders'));
});

function total(rows) {
  return rows.length;
}
""",
    "web/List.js": """\
// Order list.
export default function List() {
  axios.get('/api/orders');
  return (
    <ul />
  );
}
""",
    "web/App.js": "const App = () => <Route path=\"/list\" component={List} />;\n",
    "dist/app.js": "function no() {}\n",
    "web/packed.js": "function no() {}" + "x" * 2001 + "\n",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, len(t), t) for p, t in FILES.items()]
    return spark.createDataFrame(rows, "repo string, path string, size bigint, text string")


@pytest.fixture(scope="module")
def built(spark, files):
    units, stats = build_map(files, areas=[("order", "shop")])
    return units.cache(), stats.cache()


def test_build(built):
    units, stats = built
    names = {u.name: u for u in units.collect()}
    assert set(names) == {"GET /api/orders", "total", "List", "App"}
    assert names["List"].type == "page" and names["GET /api/orders"].area == "shop"
    info = {s.file: s for s in stats.collect()}
    assert set(info) == {"srv/orders.js", "web/List.js", "web/App.js"}
    assert info["srv/orders.js"].n_units == 2 and info["srv/orders.js"].lines == 12
    meta = M.map_meta(units, stats, "demo").first()
    assert (meta.version, meta.n_files, meta.n_units) == (1, 3, 4)


def test_counts(built):
    rows = [(r.type, r.n, r.without_description) for r in M.unit_counts(built[0]).collect()]
    assert rows == [("component", 1, 1), ("endpoint", 1, 0), ("function", 1, 1), ("page", 1, 0)]


def test_index_and_store(spark, built, tmp_path):
    units, stats = built
    path = str(tmp_path / "map")
    M.write_map(units, stats, path, project="demo", generated="2026-01-01", as_json=True)
    text = "\n".join(r.value for r in spark.read.text(f"{path}/index").collect())
    assert "# Codebase map" in text and "Project: demo" in text
    assert "### srv/orders.js (12 lines) - Orders: list and close." in text
    assert ("- `5-7` **GET /api/orders** - List the orders. "
            "[tables: shop_orders; auth: auth]") in text
    assert "- `9-11` **total** - (no description)" in text
    assert "[api: /api/orders; route: /list]" in text
    assert text.index("## Area: shop") < text.index("### srv/orders.js") < text.index("`5-7`")
    assert text.index("`5-7`") < text.index("`9-11`") < text.index("## Area: web")
    back = M.load_map(spark, path)
    assert sorted(back[0].collect(), key=str) == sorted(units.collect(), key=str)
    assert spark.read.json(f"{path}/units_json").count() == 4
    assert M.load_map(spark, str(tmp_path / "none")) is None
    spark.range(2).write.parquet(str(tmp_path / "bad/units"))
    spark.range(2).write.parquet(str(tmp_path / "bad/files"))
    assert M.load_map(spark, str(tmp_path / "bad")) is None


def test_descriptions(spark, built, files):
    units, _ = built
    given = spark.createDataFrame([
        ("r", "srv/orders.js::total", " Counts rows. "), ("r", "srv/orders.js:5 GET /api/orders", "Reads."),
        ("r", "srv/orders.js::GET /api/orders", "Second."), ("r", "web/List.js::List", "  "),
        ("r", "nothing", "x")], "repo string, key string, text string")
    got = {u.name: u.description for u in D.merge_descriptions(units, given).collect()}
    assert got == {"total": "Counts rows.", "GET /api/orders": "Reads.", "List": "Order list.", "App": ""}
    done = spark.createDataFrame([("r", "web/App.js:1 App")], "repo string, id string")
    missing = D.missing_descriptions(units, done)
    assert [u.name for u in missing.collect()] == ["total"]
    assert D.missing_descriptions(units, done.limit(0), 1).count() == 1
    (request,) = D.description_batches(missing, files).collect()
    assert request.ids == ["srv/orders.js:9 total"]
    assert request.prompt == (
        "File: srv/orders.js\nFirst lines of the file:\n```\n" + "\n".join(
            FILES["srv/orders.js"].split("\n")[:5]) + "\n```\n\nUnits:\n\n"
        "### id: srv/orders.js:9 total\n(function total, lines 9-11)\n```\n"
        "function total(rows) {\n  return rows.length;\n}\n```")


def test_batches_of_one_file(spark):
    text = "\n".join(f"function f{i}() {{}}" for i in range(60))
    files = spark.createDataFrame([("r", "a.js", len(text), text)],
                                  "repo string, path string, size bigint, text string")
    units, _ = build_map(files)
    rows = D.description_batches(D.missing_descriptions(
        units, spark.createDataFrame([], "repo string, id string")), files).orderBy("batch_no").collect()
    assert [len(r.ids) for r in rows] == [25, 25, 10]
    assert rows[1].ids[0] == "a.js:26 f25"


def test_merge_new(spark):
    schema = "repo string, key string, text string"
    old = spark.createDataFrame([("r", "a", "old"), ("r", "b", "")], schema)
    new = spark.createDataFrame([("r", "a", "new"), ("r", "b", "b  b\n c"), ("r", "c", "x" * 200), ("r", "d", " ")], schema)
    got = {r.key: r.text for r in D.merge_new_descriptions(old, new).collect()}
    assert got == {"a": "old", "b": "b b c", "c": "x" * 160}
    twice = D.merge_new_descriptions(old.union(old).unionByName(spark.createDataFrame(
        [("r", "e", "z"), ("r", "e", "y"), ("r", "e", "")], schema)), new.union(new)).collect()
    assert sorted((r.key, r.text) for r in twice) == sorted({**got, "e": "y"}.items())
    usage = spark.createDataFrame([("r", 1000, 100), ("r", 500, 50)],
                                  "repo string, input_tokens bigint, output_tokens bigint")
    cost = D.description_cost(usage).first()
    assert (cost.requests, cost.tokens, cost.cost_usd) == (2, 1650, 0.00225)
    assert spark.range(1).select(D.estimated_tokens(F.lit("a" * 10))).first()[0] == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_descriptions_of_small_files_are_not_broadcast(spark, built, tmp_path):
    """Keys and texts made of a few bytes in a file may be too many for the driver: what counts is their size."""
    built[0].write.parquet(str(tmp_path / "u"))
    units = spark.read.parquet(str(tmp_path / "u"))
    spark.range(200_000).select((F.col("id") * 0).alias("k")).coalesce(1).write.parquet(str(tmp_path / "k"))
    few = spark.read.parquet(str(tmp_path / "k"))
    key = F.concat(F.lit("web/App.js:1 App"), F.repeat(F.lit(" "), F.col("k").cast("int")),
                   F.repeat(F.lit("x"), F.col("k").cast("int")))
    done = few.select(F.lit("r").alias("repo"), F.concat(key, F.lit("#" * 60)).alias("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4MB")
    try:
        missing = D.missing_descriptions(units, done)
        assert "BroadcastHashJoin" not in _plan(missing)
        assert [u.name for u in missing.orderBy("start").collect()] == ["App", "total"]
        files = spark.createDataFrame([("r", "srv/orders.js", FILES["srv/orders.js"])], "repo string, path string, text string")
        files.write.parquet(str(tmp_path / "f"))
        requests = D.description_batches(missing, spark.read.parquet(str(tmp_path / "f")))
        assert "BroadcastHashJoin" not in _plan(requests) and requests.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
