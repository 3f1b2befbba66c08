import itertools

import pytest
from pyspark.sql import functions as F

from codelode.functions import paths as P
from codelode.sources import corpus as C

GLOBS = [
    ("node_modules", "a/node_modules/b.js", True), ("*.min.js", "x/y/app.min.js", True),
    ("*.min.js", "x/y/app.js", False), ("server/**", "server/routes/x.js", True),
    ("server/**", "web/x.js", False), ("**/*.spec.js", "a/b/c.spec.js", True),
    ("**/*.spec.js", "c.spec.js", True), ("server/tools", "server/tools/map/x.py", True),
    ("src/?.js", "src/a.js", True), ("src/?.js", "src/ab.js", False),
    ("build", "src/build.js", False), ("", "x", False), ("./a/", "b/a/c", True),
    ("/a/b", "a/b/c", True), ("a+b", "x/a+b/c", True), ("**x", "p/aax", True), ("**x", "p/a/b", False),
]


def test_globs(spark):
    df = spark.createDataFrame(GLOBS, "g string, p string, want boolean")
    by_column = df.select("g", "p", "want", F.coalesce(
        F.rlike(F.col("p"), P.glob_regex_of(F.col("g"))), F.lit(False)).alias("got")).collect()
    assert [r for r in by_column if r.got != r.want] == []
    one = df.select(*[P.glob_match(F.lit(p), g).alias(f"c{i}")
                      for i, (g, p, _) in enumerate(GLOBS)]).first()
    assert list(one) == [w for _, _, w in GLOBS]
    many = df.select(*[P.any_glob(F.lit(p), [g, "no/such", "none"]).alias(f"c{i}")
                       for i, (g, p, _) in enumerate(GLOBS)]).first()
    assert list(many) == [w for _, _, w in GLOBS]


def test_detect_lang(spark):
    cases = {"a/b.js": "js", "a/b.tsx": "ts", "b.py": "py", "x.kts": "kotlin", "x.CS": "csharp",
             "x.rb": "ruby", "README.md": None, ".bashrc": None, "Makefile": None, "a.b/c": None,
             "a\\b.go": "go", "a.": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.l for r in df.select("p", P.detect_lang(F.col("p")).alias("l")).collect()} == cases


def test_area(spark):
    areas = [("(", "broken"), ("order|mail", "shop"), ("parts/press", "press")]
    cases = {"srv/routes/orders.js": "shop", "web/parts/press/Panel.js": "press",
             "srv/routes/users.js": "srv", "server.js": "root"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = df.select("p", P.area_of(F.col("p"), areas).alias("a")).collect()
    assert {r.p: r.a for r in got} == cases


def test_list_files(spark):
    rows = [("r", p, 10, "x") for p in (
        "api/app.py", "web/App.js", "README.md", "package.json", "node_modules/x/i.js",
        "web/app.min.js", ".codelode/map.js", "web/App.js", "docs/a.md")]
    rows.append(("r", "big.js", 1024 * 1024 + 1, "x"))
    files = spark.createDataFrame(rows, "repo string, path string, size bigint, text string")
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(C.list_files(files)) == ["api/app.py", "web/App.js"]
    assert names(C.list_files(files, include=["web/**", "README.md"], exclude=["**/none.js"])) == [
        "README.md", "web/App.js"]
    assert names(C.list_files(files, include=["docs/**"])) == []


def test_minified(spark):
    cases = {"a" * 2001: True, "a" * 2000: True, "\n".join(["a" * 301] * 3): True,
             "\n".join(["a" * 300] * 3): False, "x\n" * 100 + "b" * 2000: False, "": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want boolean")
    assert [r for r in df.select("want", C.is_minified(F.col("t")).alias("got")).collect()
            if r.want != r.got] == []


def test_ignore(spark):
    text = "a\n!b\n# c\n\n d/ \n\\#x # note\n"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(C.parse_ignore(F.col("t")).alias("r")).first().r
    assert [(e.pattern, e.negate) for e in got] == [
        ("a", False), ("b", True), ("d/", False), ("#x", False)]
    rules = "# rules\nignored.js\ntmp/\n!keep.js\n*.gen.js\n!ok.gen.js\nlogs/**\n"
    paths = {"ignored.js": False, "src/ignored.js": False, "tmp/gen.js": False, "keep.js": True,
             "tmp/keep.js": False, "a.gen.js": False, "ok.gen.js": True, "src/app.js": True,
             "logs/x.js": False, ".gitignore": True}
    rows = [("r", p, rules if p == ".gitignore" else "x") for p in paths]
    rows += [("other", "ignored.js", "x")]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    for limit in (10, 0):
        kept = C.ignore_filter(files, C.ignore_rules(files), broadcast_repos=limit)
        got = {(r.repo, r.path) for r in kept.collect()}
        assert got == {("r", p) for p, ok in paths.items() if ok} | {("other", "ignored.js")}


def plain_ignored(path, rules):
    """The last rule that matches decides; below an ignored directory all is ignored. Rules here are a
    name or a name and a slash."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        rel, dropped = parts[:depth], False
        for rule in rules:
            name = rule.removeprefix("!").removesuffix("/")
            if name in rel:
                dropped = not rule.startswith("!")
        if dropped:
            return True
    return False


def test_ignored_directories_are_passed_down(spark):
    lists = {"a": ["x", "!y", "z/"], "b": ["x", "!y", "z/"], "c": ["y", "!x", "y"], "d": []}
    names = ["x", "y", "z", "w"]
    paths = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(names, repeat=n)]
    files = spark.createDataFrame([(r, p, "t") for r in lists for p in paths], "repo string, path string, text string")
    rules = spark.createDataFrame(
        [(r, i, x.removeprefix("!"), x.startswith("!")) for r, xs in lists.items() for i, x in enumerate(xs)],
        "repo string, rule_no int, pattern string, negate boolean")
    for limit in (1000, 1):
        got = {tuple(r) for r in C.ignore_filter(files, rules, limit).select("repo", "path").collect()}
        assert got == {(r, p) for r, xs in lists.items() for p in paths if not plain_ignored(p, xs)}


def test_rules_of_one_effect_are_one_pattern(spark):
    df = spark.createDataFrame([([("a", False), ("b/", False), ("", False), ("c", True), ("d", False)],)],
                               "r array<struct<pattern:string,negate:boolean>>")
    runs = df.select(C.compiled_rules(F.col("r")).alias("c")).first().c
    assert [r.negate for r in runs] == [False, True, False]
    assert runs[0].dir_regex is not None and runs[1].dir_regex is None


def test_load_files(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_bytes("def f():\n    pass\n".encode())
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.js").write_bytes(b"var a = 1; // \xff\n")
    (tmp_path / "two" / "big.js").write_bytes(b"x" * (1024 * 1024 + 1))
    files = C.load_files(spark, str(tmp_path))
    small = C.size_cap(files)
    got = {(r.repo, r.path, r.size): r.text for r in small.collect()}
    assert [tuple(r) for r in C.oversized(files).collect()] == [("two", "big.js", 1024 * 1024 + 1)]
    assert C.list_files(files, max_bytes=1 << 30).count() == 3
    assert "LessThanOrEqual(length" in small._jdf.queryExecution().executedPlan().toString()
    assert got == {("one", "src/a.py", 18): "def f():\n    pass\n",
                   ("two", "b.js", 16): "var a = 1; // �\n"}
    assert [r.path for r in C.load_files(spark, str(tmp_path / "one"), "x").collect()] == ["src/a.py"]
    lines = C.explode_lines(C.load_files(spark, str(tmp_path / "one"), "x")).collect()
    assert [(r.pos, r.line) for r in lines] == [(0, "def f():"), (1, "    pass"), (2, "")]


@pytest.mark.parametrize("pattern,path,want", [("a/*", "a/b/c.js", True), ("a/*.js", "a/b/c.js", False)])
def test_glob_of_a_folder(spark, pattern, path, want):
    assert spark.range(1).select(P.glob_match(F.lit(path), pattern)).first()[0] is want
