"""Merkle manifest against a plain tree."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codelode.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest("".join(map(said, [row.doc_id, row.source, row.lang, row.n_chars, text])))


def climb(nodes, arity):
    """Root of the nodes, and per node its (place, run) level by level."""
    witness, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), arity)
        for at in runs:
            run = nodes[at:at + arity]
            for k in range(len(run)):
                for i in below[at + k]:
                    witness[i].append((k, run))
        below = [sum(below[at:at + arity], []) for at in runs]
        nodes = [digest("".join(nodes[at:at + arity])) for at in runs]
    return nodes[0], witness


def brute(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    if not langs:
        return []
    for g in langs:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = [climb([leaf(r, r.text) for r in groups[g]], arity) for g in langs]
    root, top = climb([t[0] for t in trees], arity)
    out = []
    for g, (subroot, witness), above in zip(langs, trees, top, strict=True):
        for r, w in zip(groups[g], witness, strict=True):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            own = leaf(r, r.text.translate(SMALL) if tampered and r.text is not None else r.text)
            others = ""
            for k, run in w + above:
                others += "".join(run[:k] + run[k + 1:])
                own = digest("".join([*run[:k], own, *run[k + 1:]]))
            out.append((r.doc_id, leaf(r, r.text), subroot, root, digest(others), own, own == root))
    return out


@pytest.fixture(scope="module")
def edges(spark):
    rnd = random.Random(3)
    rows = [(None, None, None, None, None), (None, "No Id", "en", "a", 5), (None, "No Id", "en", "a", 5),
            (None, "no id", "en", None, 5), (1, "", "", "", 0), (2, "LONG Text " * 200_000, "fr", "a", 7),
            (3, "ÄÖ a:b-", "é", "s", -1), (4, "tie", "z", "s", 1), (4, "TIE", "z", "s", 1)]
    rows += [(i, "Some Words" * rnd.randint(0, 3), rnd.choice(["en", "en", "de", None]), "a", i)
             for i in range(5, 160)]
    rows += rows[20:30] + [(2000 + i, "T", f"lang{i}", "s", 0) for i in range(20)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_report(spark, sf_dir, edges):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (docs, edges):
        got = merkle.manifest_report(df.withColumn("root", F.lit("mine")).withColumn("leaf", F.lit(1)))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert Counter(map(tuple, got.collect())) == Counter(brute(df.collect()))
    assert merkle.manifest_report(edges.where("false")).count() == 0


def test_lone_leaf(spark, edges):
    (got,) = merkle.manifest_report(edges.where("doc_id = 3")).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified
    assert got.proof_sha256 == digest("")


@pytest.mark.parametrize(("arity", "levels"), [(2, 1), (2, 3), (3, 2), (8, 1)])
def test_blocks_of_blocks(spark, edges, arity, levels):
    rows = edges.select("doc_id", "lang", F.lit("x").alias("siblings"), merkle.leaf_hash(
        *[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("own"))
    made = merkle.manifest(rows, F.col("own"), F.col("lang"), [F.col("doc_id")], arity, levels)
    got = made.select("doc_id", "own", "subroot", "root", merkle.proof_hash(F.col("siblings")), merkle.folded(
        F.col("leaf"), F.col("places"), F.col("siblings")).alias("folded")).collect()
    assert all(r.root == r.folded for r in got)
    assert Counter(map(tuple, [r[:5] for r in got])) == Counter(r[:5] for r in brute(edges.collect(), arity))


def test_appender_extends_witnesses():
    for n in range(1, 140):
        tree, nodes = merkle.Appender(4), [digest(str(i)) for i in range(n)]
        for d in nodes:
            tree.append(d)
        root, witness = climb(nodes, 4)
        assert tree.finish() == root
        assert tree.witness == [[(k, "".join(run[:k] + run[k + 1:])) for k, run in w] for w in witness]
