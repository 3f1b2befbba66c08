"""Long blocks, comments and tags: how far mining looks, and that cut units say so."""

import pytest
from pyspark.sql import functions as F

from codelode.operators import extract as X, extras
from codelode.operators.limits import Limits, stretches
from codelode.operators.routes import file_routes
from codelode.plans.build import build_map

NO_LIMITS = Limits(None, None, None, None, None, None, None)


def body(n, line):
    return "".join(line.format(i=i) for i in range(n))


FILES = {
    "a/long.js": "// Long one.\nfunction long() {\n" + body(5000, "  step({i});\n")
                 + "  db.query('SELECT * FROM last_table');\n}\nfunction after() {\n  return 1;\n}\n",
    "a/long.py": "def long():\n    '''Doc.'''\n" + body(5000, "    step({i})\n")
                 + "    return db.execute('SELECT * FROM last_table')\n\ndef after():\n    return 1\n",
    "a/long.rb": "def long\n" + body(5000, "  step {i}\n") + "  db.query('SELECT * FROM last_table')\nend\n\ndef after\n  1\nend\n",
    "a/long.sql": "CREATE VIEW long AS\n" + body(5000, "-- {i}\n") + "SELECT * FROM last_table;\nCREATE TABLE after (id INT);\n",
    "a/comment.py": "# " + "word " * 100 + "\ndef said():\n    pass\n\n" + "@app.get('/far')\n" + "# note\n" * 12
                    + "def far():\n    pass\n",
    "a/block.js": "/*\n" + " * line\n" * 80 + " */\nfunction noted() {\n  return 1;\n}\n",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", p, len(t), t) for p, t in FILES.items()]
    return spark.createDataFrame(rows, "repo string, path string, size long, text string")


def mined(files, **options):
    units, _ = build_map(files, unique=True, **options)
    return {(r.file, r.name): r for r in units.collect()}


def test_default_limits_cut_and_say_so(files):
    units = mined(files)
    for path in ("a/long.js", "a/long.py", "a/long.rb"):
        long = units[path, "long"]
        assert long.cut and long.extra.tables is None and long.end == long.start + 400
        assert not units[path, "after"].cut
    assert units["a/long.sql", "table after"].cut is False and units["a/long.sql", "view long"].cut
    said = units["a/comment.py", "said"]
    assert said.cut and len(said.comment) == 240
    assert not any(r.type == "endpoint" for r in units.values())
    assert units["a/block.js", "noted"].comment == ""


def test_no_limits(files):
    units = mined(files, limits=NO_LIMITS)
    assert not any(r.cut for r in units.values())
    for path, name in (("a/long.js", "long"), ("a/long.py", "long"), ("a/long.rb", "long"), ("a/long.sql", "view long")):
        long = units[path, name]
        assert long.extra.tables == ["last_table"] and long.end - long.start > 5000
        assert units[path, "table after" if path.endswith("sql") else "after"].start > long.end
    assert units["a/comment.py", "said"].comment == ("word " * 100).strip()
    assert units["a/comment.py", "GET /far"].extra.handler == "far"
    assert units["a/block.js", "noted"].comment == ("line " * 80).strip()


def test_limits_of_ones_own(files):
    units = mined(files, limits=Limits(block_lines=6000, comment_chars=9))
    assert units["a/long.js", "long"].extra.tables == ["last_table"]
    assert not units["a/long.js", "long"].cut and units["a/comment.py", "said"].comment == "word word"


@pytest.mark.parametrize("limit", [None, 0, 1, 11, 12, 13, 400, 5000])
def test_stretches_grow_to_the_limit(limit):
    found = stretches(limit)
    assert found == sorted(set(found)) and found[-1] == (1 << 30 if limit is None else limit)


def test_route_tags_of_any_length(spark):
    attributes = " ".join(f'data-{i}={{{{a: "{i}>{i}"}}}}' for i in range(120))
    closed = f'<Route {attributes} path="/far" component={{Far}} />'
    unclosed = '<Route path="/near" component={Near} ' + "x " * 400 + ' element={<Late'
    assert len(closed) > 2000
    df = spark.createDataFrame([(closed,), (unclosed,)], "t string")
    got = [r.routes for r in df.select(file_routes(F.col("t")).alias("routes")).collect()]
    assert [[tuple(x) for x in r] for r in got] == [[("Far", "/far")], [("Near", "/near")]]


def brute_middleware(rest):
    """Pieces between commas outside brackets, up to the bracket that closes the call."""
    parts, now, depth = [], "", 0
    for ch in rest.lstrip().removeprefix(","):
        if ch in ")]}" and not depth:
            break
        depth += (ch in "([{") - (ch in ")]}")
        if ch == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += ch
    return [p.strip() for p in [*parts, now] if p.strip()]


def test_middleware_in_nested_brackets(spark):
    deep = "need(" * 7 + "a, [b, {c: (d, e)}]" + ")" * 7
    rests = [f", auth, {deep}, async (req, res) => {{", f", {deep}, auth, handler);", ", one, two(", ", a, [b], c => 1)",
             ", auth, handler), other", ", {a: 1}, b", "", ", "]
    df = spark.createDataFrame([(r,) for r in rests], "rest string")
    got = df.select(F.col("rest"), extras._arguments(F.regexp_replace("rest", r"^\s*,", "")).alias("a"),
                    extras.middleware(F.col("rest")).alias("names")).collect()
    for r in got:
        assert r.a.all == brute_middleware(r.rest), r.rest
    names = [r.names for r in got]
    assert names[0] == ["auth", deep] and names[1] == [deep, "auth"] and names[2] == ["one"]
    assert names[3] == [] and names[4] == ["auth"] and names[5:] == [[], [], []]


def test_many_definitions_on_lines_of_their_own(spark):
    text = "".join(f"function f{i}() {{ return {i}; }}\n" for i in range(3000))
    df = spark.createDataFrame([("r", "a/many.js", text)], "repo string, path string, text string")
    units = X.mined_units(X.mine_files(df))
    assert units.agg(F.count("*"), F.max("end"), F.max(F.col("end") - F.col("start"))).first()[:] == (3000, 3000, 0)
