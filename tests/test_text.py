import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,expected", [
    ("Inserisci il fornitore nella tabella delle fatture", ["inserisci", "fornitore", "tabella", "fatture"]),
    ("Add the invoice to the supplier table", ["invoice", "supplier", "table"]),
    ("/api/orders fetchOrderRows", ["api", "orders", "fetch", "order", "rows"]),
    ("perché è già così", []),
    ("Città naïve Ångström Łódź", ["citta", "naive", "angstrom", "odz"]),
    ("", []), (None, []),
])
def test_tokenize(spark, value, expected):
    assert one(spark, value, T.tokenize) == expected


@pytest.mark.parametrize("a,b", [
    ("orders", "order"), ("fornitori", "fornitore"), ("fatture", "fattura"),
    ("updated", "update"), ("creation", "create"), ("builders", "builder"),
    ("lavorazione", "lavorare"), ("loading", "load"), ("queries", "query"),
])
def test_stem_pairs(spark, a, b):
    assert one(spark, a, T.stem) == one(spark, b, T.stem)


def test_stem_edges(spark):
    words = {"ore": "ore", "": "", "loading": "load", "lament": "lament", "bus": "bus", "class": "class"}
    for word, expected in words.items():
        assert one(spark, word, T.stem) == expected, word


def plain_stem(word):
    """Independent check: suffix by suffix with plain string methods."""
    long_tail = sorted("azion ament atur ion ent at ut it al ar er ir".split(), key=len, reverse=True)

    def drop(w, endings, new=""):
        for e in endings:
            if w.endswith(e):
                short = w[: len(w) - len(e)] + new
                return short if len(short) >= 3 else w
        return w

    for _ in range(4):
        w = drop(word, ["ies"], "y")
        if not w.endswith(("ss", "us", "is")):
            for e in ("ers", "es", "s"):
                cut = drop(w, [e])
                if cut != w:
                    w = cut
                    break
        w = drop(w, ["tion", "ing", "ed"])
        w = drop(w, list("aeio"))
        word = drop(w, long_tail)
    return word


def test_stem_on_a_whole_vocabulary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocab = docs.select(F.explode(T.tokenize(F.col("text"))).alias("w")).distinct()
    rows = vocab.select("w", T.stem(F.col("w")).alias("s")).collect()
    assert len(rows) > 1000
    assert [(r.w, r.s) for r in rows if plain_stem(r.w) != r.s] == []


def test_keyword_score(spark):
    df = spark.createDataFrame([("GET /api/orders list of orders", "GET /api/orders", "list the orders")],
                               "s string, n string, q string")
    row = df.select(T.keyword_score_unit(F.col("s"), F.col("n"), F.col("q")).alias("unit"),
                    T.keyword_score(F.col("s"), F.col("q")).alias("text"),
                    T.keyword_score(F.col("s"), F.lit("")).alias("none")).first()
    assert (row.unit, row.text, row.none) == (2.5, 2, 0)


@pytest.mark.parametrize("value,expected", [
    ("fix the paid filter", False), ("fix the filter; add the row", True), ("one line\nanother", True),
    ("bridge for press, layout system colours", True), (" ".join("abcdefghijklmno"), True), (" ".join("abcdefghijklmn"), False),
])
def test_looks_composite(spark, value, expected):
    assert one(spark, value, T.looks_composite) is expected


@pytest.mark.parametrize("value,expected", [
    ("metti il fornitore nella lista fatture e poi sistema il filtro pagate",
     ["metti il fornitore nella lista fatture", "sistema il filtro pagate"]),
    ("Show the sums in the sheet, also export it as CSV",
     ["Show the sums in the sheet", "export it as CSV"]),
    ("fix: order list\n- add supplier column\n- fix paid filter",
     ["order list", "add supplier column", "fix paid filter"]),
    ("bridge for press, layout system colours, batch sums endpoint",
     ["bridge for press", "layout system colours", "batch sums endpoint"]),
    ("fix the paid filter, please", ["fix the paid filter, please"]),
    ("same part here; Same part here", ["same part here; Same part here"]),
    ("BE: rename the supplier field FE: rename the supplier label",
     ["rename the supplier field", "rename the supplier label"]),
    ("", [""]),
    (";".join(f"part number {i}" for i in range(12)), [f"part number {i}" for i in range(12)]),
])
def test_split_task(spark, value, expected):
    assert one(spark, value, T.split_task) == expected
    assert one(spark, value, lambda c: T.split_task(c, 2)) == expected[:2]


def test_task_parts(spark):
    assert one(spark, "   ", T.task_parts) == []
    assert one(spark, "a; b", lambda c: T.task_parts(c, "none")) == ["a; b"]
