"""Lattice hashing of embeddings against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import lattice

SCHEMA = "vec_id long, embedding array<double>, label int"


def unit(v):
    if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
        return None
    v = np.array(v, dtype=float)
    return v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) if np.abs(v).max() > 0 else None


def brute(rows, cosine=0.9):
    """Counter of (id, n_links, component_id, kept)."""
    units = [unit(v) for _, v in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    by_dim = {}
    for i, u in enumerate(units):
        if u is not None:
            by_dim.setdefault(len(u), []).append(i)
    for at in by_dim.values():
        met = np.stack([units[i] for i in at])
        for i, j in zip(*np.nonzero(np.triu(met @ met.T >= cosine, 1))):
            links[at[i]] += 1
            links[at[j]] += 1
            a, b = group[at[i]], group[at[j]]
            if a != b:
                group = [a if g == b else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return Counter((i, n, least.get(g), i == least.get(g))
                   for (i, _), n, g in zip(rows, links, group, strict=True))


def near(rnd, v, cosine):
    """A vector at this cosine from ``v``, of any length."""
    other = rnd.normal(size=len(v))
    other -= (other @ v) / (v @ v) * v
    made = cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
    return made * rnd.uniform(0.1, 9)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(2)
    out = [(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [1.0] * 15 + [None]), (-5, [1.0] * 15 + [math.nan]),
           (-6, [math.inf] + [1.0] * 15), (-7, [1.0]), (-8, [5.0]), (-9, [-1.0]), (-10, [1e300] * 16),
           (-11, [1e-300] * 16), (-12, [0.0, -0.0, 3.0]), (-13, [-0.0, 0.0, 1.0])]
    hot = rnd.normal(size=16)
    made = [near(rnd, hot, rnd.uniform(0.985, 1)) for _ in range(250)]  # one large group, most in one ball
    made += [near(rnd, hot, rnd.uniform(0.85, 0.95)) for _ in range(60)]  # at its edge
    made += [hot] * 40
    for _ in range(30):
        v = rnd.normal(size=16)
        made += [v, *[near(rnd, v, rnd.uniform(0.91, 0.999)) for _ in range(rnd.integers(0, 4))]]
        made.append(-v)
        for _ in range(3):  # chains
            v = near(rnd, v, 0.93)
            made.append(v)
    order = rnd.permutation(len(made))
    out += [(int(i), made[i].tolist()) for i in order]
    return out + out[20:25] + [(None, made[0].tolist()), (None, made[0].tolist()), (None, None), (7, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)


def tuples(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_edges_and_groups(spark, rows):
    rows = [(i, v) for i, v in rows]
    got = lattice.near_vectors(frame(spark, rows).withColumn("n_links", F.lit("mine")), tables=16, probes=24)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = Counter((i, n, c, (i == c)) for (i, n, c, _), k in brute(rows).items() for _ in range(k))
    assert tuples(got) == want
    kept = lattice.drop_near_vectors(frame(spark, rows), tables=16, probes=24)
    assert set(kept.columns) == {"vec_id", "embedding", "label"}
    assert {r.vec_id for r in kept.collect()} == {i for i, _, _, own in want if own}


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(300)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    rnd = np.random.default_rng(7)
    rows += [(10_000 + i, near(rnd, np.array(v), c).tolist())
             for i, ((_, v), c) in enumerate(zip(rows[:80], itertools.cycle([0.905, 0.93, 0.97, 0.895])))]
    assert tuples(lattice.vector_report(frame(spark, rows))) == brute(rows)
    assert lattice.vector_report(df.where("false")).count() == 0


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(1)
    for dim in (16, 64, 300):
        tables = lattice.Tables(dim, lattice.TABLES, lattice.SCALE, 1)
        x = rnd.normal(size=(1000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = np.stack([near(rnd, v, lattice.COSINE) for v in x])
        y /= np.linalg.norm(y, axis=1)[:, None]
        (own_x, near_x), (own_y, near_y) = (tables.cells(v, lattice.PROBES) for v in (x, y))
        met = [bool(set(a) & set(d) or set(b) & set(c)) for a, b, c, d in zip(
            own_x.tolist(), near_x.tolist(), own_y.tolist(), near_y.tolist(), strict=True)]
        assert sum(met) >= 990
        differ = np.unpackbits((tables.signs(x) ^ tables.signs(y)).view(np.uint8), axis=1).sum(axis=1)
        share = math.acos(lattice.COSINE) / math.pi
        assert differ.max() <= lattice.BITS * share + lattice.SIGMAS * math.sqrt(lattice.BITS * share * (1 - share))


def test_nearest_lattice_point():
    rnd = np.random.default_rng(3)
    steps = lattice.shortest_vectors()
    assert len({tuple(s) for s in steps}) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    x = rnd.uniform(-3, 3, size=(400, 8))
    points = lattice.nearest_e8(x)
    halves = np.rint(2 * points)
    assert np.allclose(2 * points, halves)
    odd = halves.astype(int) % 2
    assert ((odd == odd[:, :1]).all(axis=1)).all() and (points.sum(axis=1) % 2 == 0).all()
    off = ((x - points) ** 2).sum(axis=1)
    assert off.max() <= 1 + 1e-9
    assert (((x - points)[:, None, :] - steps[None]) ** 2).sum(axis=2).min(axis=1).min() >= 0
    assert ((((x - points)[:, None, :] - steps[None]) ** 2).sum(axis=2) >= off[:, None] - 1e-9).all()


def test_members_of_one_ball_are_linked_without_pairs(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=32)
    rows = [(i, near(rnd, v, rnd.uniform(0.99, 1)).tolist()) for i in range(1200)]
    got = lattice.near_vectors(frame(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1199, 0)}


def test_lengths_of_other_vectors_do_not_matter(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 7, 8, 9, 64, 64, 200] * 3)]
    assert tuples(lattice.near_vectors(frame(spark, rows), tables=12)) == brute(rows)
