import pytest
from pyspark.sql import functions as F

from codelode.operators import evaluate as E
from codelode.operators.extract import file_stats, mine_files, mined_units
from codelode.plans.bench import bench
from codelode.plans.find import find

LOG = """\
@@a1|feat: close an order from the list|
Longer text of the change.
Signed-off-by: Someone
Refs: 12

srv/orders.js
srv/orders.js
README.md
gone.js

@@b2|Merge branch x|

srv/orders.js
@@c3|short|

srv/orders.js
@@d4|Sum the stock lines at night|see
word
srv/stock.js
docs/plan.js
@@e5|only documents were touched here|

docs/a.md
package-lock.json
@@broken line
"""


@pytest.fixture
def commits(spark, tmp_path):
    (path := tmp_path / "commits.txt").write_text(LOG)
    return E.parse_commits(E.read_commit_log(spark, str(path), "r"))


def test_parse(commits):
    rows = {c.hash: c for c in commits.collect()}
    assert set(rows) == {"a1", "b2", "c3", "d4", "e5"}
    assert rows["a1"].files == ["srv/orders.js", "srv/orders.js", "README.md", "gone.js"]
    assert rows["d4"].files == ["word", "srv/stock.js", "docs/plan.js"]  # a bare word joins the list
    assert [b for b in rows["d4"].body if b] == ["see"]


def test_usable(commits):
    got = {c.hash: c.task for c in E.usable_commits(commits).collect()}
    assert got == {"a1": "feat: close an order from the list Longer text of the change.",
                   "d4": "Sum the stock lines at night see",
                   "e5": "only documents were touched here"}


def test_targets(spark):
    cases = {"yarn.lock": True, "a/Cargo.lock": True, "x.md": True, "a/docs/x.js": True,
             "doc/x.js": True, "docx/x.js": False, "go.sum": True, "a.JSON": True, ".md": False,
             "out/x.js": True, "outer/x.js": False}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r.path: r.x for r in df.select("path", E.is_excluded_target(
        F.col("path"), "./out/").alias("x")).collect()}
    assert got == cases


def test_measures(spark):
    ranked = spark.createDataFrame(
        [("r", "t", 1, 1, "a"), ("r", "t", 1, 2, "b"), ("r", "t", 2, 1, "c"), ("r", "t", 2, 2, "a"),
         ("r", "u", 1, 1, "x")],
        "repo string, task_id string, part_no int, rank int, file string")
    targets = spark.createDataFrame([("r", "t", "c"), ("r", "t", "b"), ("r", "t", "q"), ("r", "u", "y")],
                                    "repo string, task_id string, file string")
    union = E.union_files(ranked)
    assert {(r.task_id, r.rank): r.file for r in union.collect()} == {
        ("t", 1): "a", ("t", 2): "b", ("t", 3): "c", ("u", 1): "x"}
    assert {r.task_id: r["rank"] for r in E.first_hit_rank(union, targets).collect()} == {"t": 2, "u": 0}
    cover = {r.task_id: (r.coverage1, r.coverage3) for r in E.coverage_at_k(ranked, targets).collect()}
    assert cover == {"t": (0.333, 0.667), "u": (0.0, 0.0)}
    parts = ranked.select("repo", "task_id", "part_no").distinct()
    usage = spark.createDataFrame([("r", "t", 3, 100, 0.25)],
                                  "repo string, task_id string, calls int, tokens int, cost_usd double")
    rows = E.bench_rows(ranked, targets, parts, "scan", usage)
    s = E.bench_summary(rows).first()
    assert (s.commits, s.top1, s.top3, s.top5) == (2, 0, 50, 50)
    assert (s.calls, s.tokens, s.cost_usd, s.errors, s.coverage_top3) == (1.5, 50, 0.25, 0, 33)


def test_bench(spark, tmp_path):
    files = {"srv/orders.js": "// Close an order from the list.\nfunction closeOrder() {\n}\n",
             "srv/stock.js": "// Sum stock lines.\nfunction total() {\n}\n",
             "srv/other.js": "// Night work.\nfunction night() {\n}\n"}
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()],
                               "repo string, path string, text string")
    mined = mine_files(df)
    (path := tmp_path / "log.txt").write_text(LOG)
    blocks = E.read_commit_log(spark, str(path), "r")
    rows, summary = bench(blocks, mined_units(mined), file_stats(mined),
                          answers={"prefilter": None})
    got = {r.task_id: (r.parts, r["rank"], r.coverage1) for r in rows.collect()}
    assert got == {"a1": (1, 1, 1.0), "d4": (1, 1, 1.0)}
    s = summary.first()
    assert (s.top1, s.top5, s.coverage_top3) == (100, 100, 100)


def test_parse_odd_lines(spark):
    blocks = {"a": "a|b|c", "b": "b|s|f\n", "c": "c|s|f\n\n \n", "d": "d|s|f\n  x.py \n\ny.py\t\n  z.py\n\n",
              "e": "e|s|f\none two\n@@x\né.py\n　\n", "f": "f|s|f\nx.py\nends with words ",
              "g": "g|s|f\n" + "x\n" * 50_000}
    df = spark.createDataFrame([("r", b) for b in blocks.values()], "repo string, block string")
    got = {c.hash: (c.body, c.files) for c in E.parse_commits(df).collect()}
    assert got.pop("g") == (["f"], ["x"] * 50_000)
    assert got == {"a": (["c"], []), "b": (["f"], []), "c": (["f"], []), "d": (["f", "  x.py ", ""], ["y.py", "z.py"]),
                   "e": (["f", "one two", "@@x"], ["é.py"]), "f": (["f", "x.py", "ends with words "], [])}


def test_alike_tasks(spark):
    tasks = spark.createDataFrame(
        [("r", "1", "x"), ("r", "2", "x"), ("r", "3", "x"), ("q", "4", "x"), ("r", "5", "y"), ("r", "6", "x"),
         ("r", "6", "y"), ("r", "7", "y"), ("r", "7", "x")], "repo string, task_id string, text string")
    own = spark.createDataFrame([("r", "1"), ("r", "1")], "repo string, task_id string")
    assert {r.task_id: (r.like, r.alone) for r in E.alike_tasks(tasks).collect()} == {
        "1": ("1", False), "2": ("1", False), "3": ("1", False), "4": ("4", True), "5": ("5", True),
        "6": ("6", False), "7": ("6", False)}
    assert {r.task_id: (r.like, r.alone) for r in E.alike_tasks(tasks, own).collect()} == {
        "1": ("1", True), "2": ("2", False), "3": ("2", False), "4": ("4", True), "5": ("5", True),
        "6": ("6", False), "7": ("6", False)}


@pytest.mark.parametrize("most", [E.BROADCAST_ALIKE, 0])
def test_rows_of_alike_tasks(spark, monkeypatch, most):
    """A ranking that serves for several tasks gives the rows that its copies give."""
    monkeypatch.setattr(E, "BROADCAST_ALIKE", most)
    first = [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 3, "z"), ("a", 2, 1, "w"), ("a", 2, 2, "x"), ("d", 1, 1, "y"),
             ("d", 1, 4, "x")]
    like = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}
    ranked = spark.createDataFrame([("r", *x) for x in first], "repo string, task_id string, part_no int, rank int, file string")
    copies = spark.createDataFrame([("r", t, *x[1:]) for t, l in like.items() for x in first if x[0] == l], ranked.schema)
    alike = spark.createDataFrame([("r", t, l, l == "d") for t, l in like.items()],
                                  "repo string, task_id string, like string, alone boolean")
    found = {"a": "wx", "b": "zq", "c": "v", "d": "xy", "e": "x", "f": "yv"}
    touched = spark.createDataFrame([("r", t, f) for t, fs in found.items() for f in fs], "repo string, hash string, path string")
    parts = {"a": 2, "d": 1}
    usage = [("r", t, n, 100 * n, 0.25) for t, n in parts.items()]
    schema = "repo string, task_id string, calls bigint, tokens bigint, cost_usd double"

    def table(of):
        return spark.createDataFrame([("r", t, i) for t, l in of for i in range(parts.get(l, 0))], "repo string, task_id string, part_no int")

    targets = touched.select("repo", F.col("hash").alias("task_id"), F.col("path").alias("file"))
    spent = spark.createDataFrame([(r, t, *x) for t, l in like.items() for r, k, *x in usage if k == l], schema)
    want = E.bench_rows(copies, targets, table(like.items()), "m", spent)
    got = E.bench_rows_alike(ranked, E.grouped_targets(touched), table((t, t) for t in "ade"), "m", alike,
                             spark.createDataFrame(usage, schema))
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    given = E.bench_rows_alike(ranked, E.grouped_targets(touched), table((t, t) for t in "ade"), "m", alike, None, spent)
    assert sorted(map(str, given.collect())) == sorted(map(str, want.collect()))


def test_bench_searches_once_for_a_message(spark, tmp_path, monkeypatch):
    """Rankings of equal messages are not copied; those with answers have their own."""
    files = {f"srv/f{i}.js": f"// Close order {i}.\nfunction close{i}() {{\n}}\n" for i in range(3)}
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo string, path string, text string")
    mined = mine_files(df)
    (path := tmp_path / "log.txt").write_text("\n@@".join(f"h{i}|feat: close an order|\n\nsrv/f{i % 3}.js\n" for i in range(30)))
    searched = []

    def counted(tasks, *given, **options):
        searched.append(tasks.count())
        return find(tasks, *given, **options)

    def answers(targets):
        return targets.where("task_id = 'h7'").select(
            "repo", "task_id", F.lit(1).alias("part_no"), F.get("files", F.lit(0)).alias("file"), F.lit(2).alias("start"),
            F.lit(0.9).alias("p"))

    monkeypatch.setattr("codelode.plans.bench.find", counted)
    rows, summary = bench(E.read_commit_log(spark, str(path), "r"), mined_units(mined), file_stats(mined),
                          answers={"prefilter": None, "scan": answers})
    got = {(r.mode, r.task_id): (r.targets, r["rank"], r.calls) for r in rows.collect()}
    assert searched == [1, 2]
    assert got == {("prefilter", f"h{i}"): (1, i % 3 + 1, 0) for i in range(30)} | {
        ("scan", f"h{i}"): (1, i % 3 + 1, 0) for i in range(30)} | {("scan", "h7"): (1, 1, 1)}
    assert {r["mode"]: r.commits for r in summary.collect()} == {"prefilter": 30, "scan": 30}
