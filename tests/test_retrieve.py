import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import early_stop, retrieve as R
from codelode.operators.extract import EXTRA_TYPE
from codelode.plans.find import find
from codelode.queries.registry import bench_tasks, doc_units
from codelode.sources.mapstore import UNIT_SCHEMA

EXTRA = ["method", "path", "handler", "parent", "kind", "route", "tables", "calls", "emits",
         "imports", "middleware"]


def unit(file, type_, name, start, text, repo="r", **extra):
    return (repo, f"{file}:{start} {name}", file, "js", type_, name, start, start + 9, text, text,
            file.split("/")[0], tuple(extra.get(k) for k in EXTRA), False)


UNITS = [
    unit("srv/orders.js", "endpoint", "GET /api/orders", 10, "List orders with filters.",
         method="GET", path="/api/orders", tables=["shop_orders"]),
    unit("srv/orders.js", "endpoint", "POST /api/orders/:id/close", 60, "Close one order.",
         method="POST", path="/api/orders/:id/close", tables=["shop_orders"]),
    unit("srv/mail.js", "function", "fetchMail", 5, "Download messages.", tables=["messages"]),
    unit("web/OrderList.js", "page", "OrderList", 1, "Order list page with close button.",
         route="/orders", calls=["/api/orders", "/api/orders/${id}/close"]),
    unit("web/Button.js", "component", "Button", 1, "Plain button."),
    unit("srv/stock.js", "endpoint", "GET /api/stock", 12, "List stock.", path="/api/stock"),
    unit("srv/stock.js", "function", "total", 80, "Sum stock lines."),
    unit("jobs/sweep.js", "job", "sweep nightly", 3, "Delete old files."),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, UNIT_SCHEMA).cache()


def task(spark, text, task_id="t"):
    return spark.createDataFrame([("r", task_id, text)], "repo string, task_id string, text string")


def test_label(units):
    rows = {r.file + str(r.start): r.label for r in units.select(
        "file", "start", R.unit_label().alias("label")).collect()}
    assert rows["srv/orders.js10"] == (
        "srv/orders.js | endpoint GET /api/orders | does: List orders with filters. | "
        "tables: shop_orders")
    assert rows["web/OrderList.js1"] == (
        "web/OrderList.js | page OrderList | does: Order list page with close button. | "
        "calls: /api/orders, /api/orders/${id}/close | page /orders")


def brute_scores(spark, units, text):
    """Every unit against the task, one by one."""
    scored = units.select("file", "start", T.keyword_score_unit(
        T.unit_search_text(), T.unit_name_text(), F.lit(text)).alias("s")).collect()
    rows = [(r.file, r.start, r.s) for r in scored if r.s > 0]
    return sorted(rows, key=lambda r: (-r[2], r[0], r[1]))


@pytest.mark.parametrize("options", [{}, {"early": True}, {"broadcast_chars": 0, "salts": 3}, {"broadcast_chars": 0}])
def test_prefilter(spark, units, options):
    text = "close the order list; and then sum the stock lines"
    parts = R.parts(task(spark, text))
    got = R.prefilter(parts, R.token_index(units), 40, **options).orderBy("part_no", "rank").collect()
    for part_no, part in enumerate(["close the order list", "sum the stock lines"], 1):
        mine = [(r.file, r.start, r.score) for r in got if r.part_no == part_no]
        assert mine == brute_scores(spark, units, part)
    few = R.prefilter(parts, R.token_index(units), 2, **options)
    assert few.groupBy("part_no").count().where("count != 2").count() == 0
    none = R.parts(task(spark, "unrelated wording", "u"))
    assert R.no_candidate_parts(none, got_df := R.prefilter(none, R.token_index(units))).count() == 1
    assert got_df.count() == 0


@pytest.mark.parametrize(("n", "frequent", "seeds"), [(1, 64, 1), (12, 20, 3), (5, 0, 8), (500, 64, 8)])
def test_best_units_without_the_other_pairs(spark, n, frequent, seeds):
    rnd = random.Random(n)
    words = [f"word{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]  # a few words in most units
    units = spark.createDataFrame([
        unit(f"d{rnd.randrange(30)}/{' '.join(rnd.sample(words, 1))}.js", "function", "f", i,
             " ".join(rnd.choices(words, weights, k=30)), repo="r" if i % 3 else "q") for i in range(600)], UNIT_SCHEMA)
    parts = spark.createDataFrame([(repo, f"t{i}", 1, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 25))))
                                   for i in range(40) for repo in "rq"] + [("r", "none", 1, "unknown words only")],
                                  "repo string, task_id string, part_no int, part string")
    index = R.token_index(units).cache()
    pairs, tried = early_stop.candidates(R.part_stems(parts), index, n, frequent, seeds)
    everything = R.keyword_scores(parts, index)
    score = F.col("score")
    assert sorted(map(tuple, R._best(pairs, score, n, "rank").collect())) == sorted(
        map(tuple, R._best(everything, score, n, "rank").collect()))
    built, seeded, possible = pairs.count(), tried.count(), everything.count()
    assert pairs.dropDuplicates(["repo", "task_id", "part_no", "file", "start"]).count() == built <= possible
    if n == 1:
        assert built + seeded < possible / 2


def test_pairs_of_the_benchmark(spark, sf_dir):
    """On the given tables fewer than a fifth of the pairs with a stem in common are built."""
    index = R.token_index(doc_units(spark, "/root/testdata/sf0.01")).where("repo = 'src'").cache()
    parts = R.parts(bench_tasks(spark, "/root/testdata/sf0.01"), "none")
    pairs, tried = early_stop.candidates(R.part_stems(parts), index, 5)
    possible = R.keyword_scores(parts, index).count()
    assert 0 < pairs.count() + tried.count() < possible / 5
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Relation")[0] and "Python" not in plan


def test_numbering_with_one_large_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 100 < 90, "big").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.xxhash64("id").alias("x"))
    got = R.number_in_order(df, "g", ["x"], "n")
    want = df.selectExpr("*", "cast(row_number() over (partition by g order by x) as bigint) n")
    assert got.schema["n"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, got.select("g", "x", "n").collect())) == sorted(map(tuple, want.collect()))


def test_scan_questions(spark, units):
    rows = R.scan_questions(units, 3, "Demo").orderBy("file", "start").collect()
    assert [(r.batch_no, r.q) for r in rows] == [(i // 3, f"q{i % 3}") for i in range(8)]
    assert rows[1].instructions.startswith(
        "To carry out the task in `task` in the project (Demo), a developer must read or modify "
        "this code unit: srv/mail.js | ")
    batches = R.scan_batches(R.scan_questions(units, 3)).orderBy("batch_no").collect()
    assert [sorted(b.questions) for b in batches] == [["q0", "q1", "q2"], ["q0", "q1", "q2"], ["q0", "q1"]]
    calls = R.scan_calls(R.parts(task(spark, "fix the order list")), units, 3).first()
    assert calls.calls == 3


def test_scan_equals_the_full_product(spark, units):
    parts = R.parts(task(spark, "fix the order list; count the stock now"))
    given = [("r", "t", 1, "srv/orders.js", 10, 0.93), ("r", "t", 1, "web/OrderList.js", 1, 0.881999),
             ("r", "t", 1, "srv/mail.js", 5, 0.3), ("r", "t", 1, "srv/stock.js", 12, 0.3),
             ("r", "t", 2, "zzz.js", 1, 0.9)]
    answers = spark.createDataFrame(
        given, "repo string, task_id string, part_no int, file string, start int, p double")
    lookup = {g[2:5]: g[5] for g in given}
    for top, limit in product((2, 5, 15), (1, 3, 10)):
        scored = R.scan_scores(parts, units, answers, top, limit)
        got = R.rank_units(scored, top).orderBy("part_no", "rank").collect()
        files = R.rank_files(scored, limit).orderBy("part_no", "rank").collect()
        for part_no in (1, 2):
            full = sorted(((lookup.get((part_no, u[2], u[6]), 0.0), u[2], u[6]) for u in UNITS),
                          key=lambda x: (-x[0], x[1], x[2]))
            assert [(r.file, r.start, r.p) for r in got if r.part_no == part_no] == [
                (f, s, round(p, 3)) for p, f, s in full[:top]]
            seen = list(dict.fromkeys(f for _, f, _ in full))[:limit]
            assert [r.file for r in files if r.part_no == part_no] == seen


def test_choice(spark, units):
    parts = R.parts(task(spark, "close button of the order list page"))
    cands = R.prefilter(parts, R.token_index(units))
    crit = R.choice_criteria(cands, units, "Demo").first()
    order = [r.file for r in cands.orderBy("rank").collect()]
    assert set(crit.criteria) == {f"u{i + 1}" for i in range(len(order))} | {"none"}
    assert '"unit":"OrderList"' in crit.criteria["u1"] and order[0] == "web/OrderList.js"
    assert "in the project (Demo)" in crit.instructions
    answers = spark.createDataFrame(
        [("r", "t", 1, "u2", 0.7), ("r", "t", 1, "u1", 0.2), ("r", "t", 1, "none", 0.0406),
         ("r", "t", 1, "confidence", 0.8)],
        "repo string, task_id string, part_no int, k string, p double")
    ranked = R.rerank_choice(cands, answers).orderBy("rank").collect()
    assert [r.keyword_rank for r in ranked] == [2, 1, *range(3, len(order) + 1)]
    assert ranked[0].p == 0.7 and ranked[0].score > 0
    s = R.choice_summary(answers).first()
    assert (s.confidence, s.none) == (0.8, 0.041)
    found = find(task(spark, "close button of the order list page"), units, mode="prefilter",
                 answers=answers)
    assert found["units"].orderBy("rank").first().p == 0.7
    assert found["files"].orderBy("rank").first().file == order[1]


def test_fallback_and_find(spark, units):
    tasks = task(spark, "archive the order").union(task(spark, "sweep files", "u"))
    found = find(tasks, units)
    first = found["units"].where("task_id = 't' and rank = 1").first()
    assert first.p is None and first.score == 1.5 and first.line == 10
    assert found["files"].where("task_id = 'u'").count() == 1
    answers = spark.createDataFrame(
        [("r", "t", 1, "srv/mail.js", 5, 0.5)],
        "repo string, task_id string, part_no int, file string, start int, p double")
    mixed = find(tasks, units, answers=answers)
    top = {r.task_id: (r.file, r.p) for r in mixed["units"].where("rank = 1").collect()}
    assert top == {"t": ("srv/mail.js", 0.5), "u": ("jobs/sweep.js", None)}
    assert mixed["units"].where("task_id = 't'").count() == len(UNITS)
    with pytest.raises(ValueError):
        find(tasks, units, mode="other")


def test_cost(spark):
    usage = spark.createDataFrame([("r", "t", 1, 800), ("r", "t", 2, 51000)],
                                  "repo string, task_id string, part_no int, tokens bigint")
    row = R.task_cost(usage).first()
    assert (row.calls, row.tokens, row.cost_usd) == (2, 51800, round(0.000034 + 0.002142, 6))


def test_callers(units):
    got = {(r.path, r.caller.split(":")[0]) for r in R.callers_of(units).collect()}
    assert got == {("/api/orders", "web/OrderList.js"), ("/api/orders/:id/close", "web/OrderList.js")}


def test_a_key_with_most_rows_is_dealt_out(spark):
    large = spark.range(4000).select(
        F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, F.concat(
            F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"), "id")
    other = spark.createDataFrame([("big", 1), ("big", 2), ("k5", 3), ("none", 4)], "key string, n int")
    dealt, spread = R.salted(large, other, ["key"], ["id"], 100)
    sizes = {(r.key, r.salt): r["count"] for r in dealt.groupBy("key", "salt").count().collect()}
    assert sum(k == "big" for k, _ in sizes) == 32 and max(
        n for (k, _), n in sizes.items() if k) < 200
    assert {r.key: r["count"] for r in spread.groupBy("key").count().collect()} == {
        "big": 64, "k5": 1, "none": 1}
    got = dealt.join(spread, ["key", "salt"]).select("key", "id", "n")
    want = large.join(other, "key").select("key", "id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_callers_by_templates(spark):
    paths = ["/users/:id", "/users/me", "/users/{id}/posts", "/:any/42/posts", "/users/<int:id>/", "/a/b", "/"]
    ends = [unit("srv/a.js", "endpoint", f"GET {p}", n, "E.", path=p) for n, p in enumerate(paths)]
    ends.append(unit("srv/b.js", "endpoint", "GET /users/:id", 1, "Elsewhere.", repo="q", path="/users/:id"))
    calls = ["/users/42", "/users/me?x=1", "/users/${id}", "/users/42/posts", "/x/42/posts", "/users", "/a/b#c",
             "/a/${b}", "/", "/users/7/"]
    page = [unit("web/p.js", "page", "P", 1, "Page.", calls=calls)]
    units = spark.createDataFrame([*ends, *page], UNIT_SCHEMA)
    got = {}
    for r in R.callers_of(units, rows=3).collect():
        got.setdefault(r.call, set()).add(r.path)
    by_id = {"/users/:id", "/users/<int:id>/"}
    assert got == {"/users/42": by_id, "/users/me?x=1": {"/users/me"}, "/users/${id}": by_id,
                   "/users/42/posts": {"/users/{id}/posts"}, "/x/42/posts": {"/:any/42/posts"},
                   "/a/b#c": {"/a/b"}, "/": {"/"}, "/users/7/": by_id}


def test_callers_of_one_busy_path(spark):
    ends = [unit("srv/home.js", "endpoint", "GET /", n, "Home.", path="/") for n in (1, 2)]
    pages = [unit(f"web/p{n}.js", "page", f"P{n}", 1, "Page.", calls=["/"]) for n in range(60)]
    units = spark.createDataFrame([*ends, *pages], UNIT_SCHEMA)
    got = [tuple(r) for r in R.callers_of(units, rows=7).collect()]
    assert len(got) == len(set(got)) == 120
    assert sorted(got) == sorted(map(tuple, R.callers_of(units).collect()))


def test_apply_answers(spark):
    q = spark.createDataFrame([("r", "t", 1, "a.js", 1), ("r", "t", 1, "b.js", 1)],
                              "repo string, task_id string, part_no int, file string, start int")
    a = q.where("file = 'a.js'").withColumn("p", F.lit(0.4))
    assert {r.file: r.p for r in R.apply_answers(q, a).collect()} == {"a.js": 0.4, "b.js": 0.0}


def test_schema(units):
    assert dict(units.dtypes)["extra"] == EXTRA_TYPE


def test_stored_index(spark, units):
    R.write_token_index(units, "unit_stems", 7)
    parts = R.parts(task(spark, "close the order list"))
    stored = R.prefilter(parts, spark.table("unit_stems"))
    fresh = R.prefilter(parts, R.token_index(units))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fresh.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan(stored).splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("task_id" in x and "start" not in x for x in moved)
    # of a fresh index only the sums per part and unit move, not its stems
    assert not [x for x in plan(fresh).splitlines() if "Exchange hashpartitioning" in x and "stem" in x]
    assert "BroadcastHashJoin" in plan(fresh)
    spark.sql("drop table unit_stems")


def test_tasks_of_mixed_search_are_dealt_out(spark, sf_dir, monkeypatch):
    from codelode.queries import registry as Q

    seen = []
    monkeypatch.setattr(Q, "code_map", lambda *_: (spark.range(3), None))
    monkeypatch.setattr(Q, "find", lambda tasks, *_, **__: seen.append(tasks) or {"units": tasks.select(
        "*", *[F.lit(1).alias(c) for c in ("part_no", "rank", "file", "id", "name", "line", "description", "score")])})
    spark.conf.set("codelode.read.partitions", "3")
    try:
        rows = Q.find_mixed(spark, sf_dir).count()
    finally:
        spark.conf.unset("codelode.read.partitions")
    assert rows == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert seen[0].rdd.getNumPartitions() > 1


def test_scan_files_are_the_best_of_all_scores(spark):
    """Files of a scan without the rows of units that nobody answered for."""
    units = spark.createDataFrame([("r", f"f{f:02d}", n) for f in range(14) for n in range(1, 3)] + [("s", "only", 1)],
                                  "repo string, file string, start int")
    parts = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("r", "b", 1), ("r", "b", 1), ("s", "c", 1), ("t", "d", 1)],
                                  "repo string, task_id string, part_no int")
    given = [("r", "a", 1, f"f{f:02d}", n, p) for f, n, p in ((13, 1, .5), (13, 2, .7), (2, 2, .7), (4, 1, 0.0), (1, 1, .1234))]
    given += [("r", "a", 2, f"f{f:02d}", 1, f / 20) for f in range(14)] + [("r", "x", 1, "f01", 1, .9), ("s", "c", 1, "gone", 1, .9)]
    answers = spark.createDataFrame(given, "repo string, task_id string, part_no int, file string, start int, p double")
    for top, limit in ((15, 10), (2, 3), (40, 30)):
        want = R.rank_files(R.scan_scores(parts, units, answers, top, limit), limit)
        got = R.scan_files(parts, units, answers, limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.columns == want.columns
