"""Near duplicates of embeddings, by hashing to the E8 lattice.

Unit vectors are projected at random to eight dimensions, several times, and each projection is decoded
to the nearest point of the E8 lattice: the name of the vector's cell in that table. Vectors are
stored under their own cell and looked up under it and the neighbouring cells that lie nearest. What
meets is verified by cosine.

Copies are one node. Very like nodes, each within half the allowed angle of a common centre, are one
*ball*: its members are all linked to each other, without being compared. Two balls are compared by
their centres; the triangle inequality of angles tells for most that all of their members are linked,
or none. Only members of the others are looked at, first against the other centre. So a group of
copies, equal or nearly so, may hold any share of the rows without its pairs being made.

Cost: a ball makes TABLES * (PROBES + 2) narrow rows. Two unrelated vectors share a cell with
probability 1 / (4 pi SCALE^2)^4, and are told apart by 256 sign bits before any vector is moved. Larger
tables want a larger scale, and more tables to keep the recall: both are arguments.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codelode.llm.common import bounded
from codelode.llm.components import components
from codelode.sources.scratch import saved

COSINE = 0.9
#: With these, a pair at a cosine of 0.9 is found with a probability of 0.999 (see the README).
TABLES, PROBES, SCALE = 8, 16, 0.85
SEED = 11
#: Rounds of looking for balls, and the scale of their cells.
BALL_ROUNDS, BALL_SCALE = 3, 0.5
#: Sign bits of a vector. A linked pair differs in more than the bound below with odds under 1e-8.
BITS, SIGMAS = 256, 6.0
#: Angles are sure to this much.
SURE = 1e-7
VECTORS_AT_ONCE = 1024


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of
    minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((-0.5, 0.5), repeat=8)
            if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer entries of even sum: rounded, and where the sum is odd, the entry
    that lies furthest from its integer is rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the nearest with integers and the nearest with halves, the nearer."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Tables:
    """Projections, cells and signs for vectors of one length."""

    def __init__(self, dim: int, tables: int, scale: float, seed: int) -> None:
        rnd = np.random.default_rng([seed, dim, tables])
        self.project = rnd.normal(size=(tables, dim, 8)) * scale
        self.shift = rnd.uniform(size=(tables, 8))
        # entries are halves, so names are sums of odd multiples; of other tables and lengths too
        self.name = rnd.integers(0, 1 << 63, size=(tables, 9), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.planes = rnd.normal(size=(dim, BITS))
        self.steps = shortest_vectors()

    def _named(self, points: np.ndarray, table: int) -> np.ndarray:
        whole = np.rint(2 * points).astype(np.int64).astype(np.uint64)
        mixed = (whole * self.name[table, :8]).sum(axis=-1, dtype=np.uint64) + self.name[table, 8]
        mixed ^= mixed >> np.uint64(29)
        return (mixed * self.name[0, 8]).view(np.int64)

    def cells(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the own cell per table, and of it and the nearest ``probes`` neighbours."""
        own, near = [], []
        for t in range(len(self.project)):
            at = x @ self.project[t] + self.shift[t]
            points = nearest_e8(at)
            own.append(self._named(points, t))
            if probes:
                nearest = np.argsort((points - at) @ self.steps.T, axis=1, kind="stable")[:, :probes]
                near.append(self._named(points[:, None, :] + self.steps[nearest], t))
        own = np.stack(own, axis=1)
        return own, np.concatenate([own, *near], axis=1)

    def signs(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes > 0, axis=1).view("<i8")


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of vectors (rows of a matrix) of one length and the rows they come from."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, values[offsets[at][:, None] + np.arange(dim)]


def _mapped(df: DataFrame, schema: str, fill: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df``, whose last column is an array of doubles, with more columns worked out from it."""
    new = StructType.fromDDL(schema)
    types, names = to_arrow_schema(new), [*df.columns, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                part = batch.slice(at, VECTORS_AT_ONCE)
                made = fill(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(c.cast(f.type) for c, f in zip(made, types, strict=True))],
                    names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))


def _units(column: pa.Array) -> list[pa.Array]:
    """Unit vectors and their names (digests of their numbers); null where there is no direction."""
    import xxhash

    units, names = [], []
    for vector in column.to_pylist():
        x = np.array([] if vector is None or None in vector else vector, dtype=np.float64)
        most = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
        if most > 0:
            x = x / most
            x = x / math.sqrt(float(x @ x)) + 0.0  # no negative zeros
            units.append(x)
            names.append(xxhash.xxh3_128_digest(x.astype("<f8").tobytes()))
        else:
            units.append(None)
            names.append(None)
    return [pa.array(units, type=pa.list_(pa.float64())), pa.array(names, type=pa.binary())]


def _cells(rounds: int, scale: float, seed: int) -> Callable[[pa.Array], list[pa.Array]]:
    """Own cells only."""
    made: dict[int, Tables] = {}

    def fill(column: pa.Array) -> list[pa.Array]:
        out = np.zeros((len(column), rounds), dtype=np.int64)
        for at, x in _vectors(column):
            dim = x.shape[1]
            if dim not in made:
                made[dim] = Tables(dim, rounds, scale, seed)
            out[at] = made[dim].cells(x, 0)[0]
        return [_lists(out)]

    return fill


def _lookups(tables: int, probes: int, scale: float, seed: int) -> Callable[[pa.Array], list[pa.Array]]:
    """Own cells and cells to look up."""
    made: dict[int, Tables] = {}

    def fill(column: pa.Array) -> list[pa.Array]:
        own = np.zeros((len(column), tables), dtype=np.int64)
        near = np.zeros((len(column), tables * (probes + 1)), dtype=np.int64)
        for at, x in _vectors(column):
            dim = x.shape[1]
            if dim not in made:
                made[dim] = Tables(dim, tables, scale, seed)
            own[at], near[at] = made[dim].cells(x, probes)
        return [_lists(own), _lists(near)]

    return fill


def _signs(seed: int) -> Callable[[pa.Array], list[pa.Array]]:
    made: dict[int, Tables] = {}

    def fill(column: pa.Array) -> list[pa.Array]:
        out = np.zeros((len(column), BITS // 64), dtype=np.int64)
        for at, x in _vectors(column):
            dim = x.shape[1]
            if dim not in made:
                made[dim] = Tables(dim, 1, 1.0, seed)
            out[at] = made[dim].signs(x)
        return [_lists(out)]

    return fill


def _dot(x: Column, y: Column) -> Column:
    """Cosine of unit vectors. Vectors of other lengths have none."""
    total = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(x) == F.size(y), total).otherwise(F.lit(-1.0))


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _balls(nodes: DataFrame, widest: float, seed: int) -> DataFrame:
    """``nodes(node, unit, ..)`` with ``ball`` (the node at its centre) and ``off`` (the angle to it)."""
    left = _mapped(nodes.select(*[c for c in nodes.columns if c != "unit"], "unit"),
                   "__cells array<long>", _cells(BALL_ROUNDS, BALL_SCALE, seed))
    left, parts = saved(left, "nodes"), []
    for r in range(BALL_ROUNDS):
        cell = F.col("__cells")[r]
        centres = left.groupBy(cell.alias("__cell")).agg(
            F.min_by(F.struct("node", "unit"), F.xxhash64("node")).alias("__centre"),
            F.count("*").alias("__n")).where("__n > 1").drop("__n")
        met = left.join(bounded(saved(centres, "centres"), 20_000), cell == F.col("__cell"), "left")
        off = F.when(F.col("__centre.node") == F.col("node"), F.lit(0.0)).otherwise(
            _angle(_dot(F.col("unit"), F.col("__centre.unit"))))
        met = saved(met.withColumn("off", off).select(
            *left.columns, "off", F.col("__centre.node").alias("ball")), "met")
        near = F.coalesce(F.col("off") <= widest - SURE, F.lit(False))
        # a centre that nothing else lies near stays free for the next round
        taken = met.where(near)
        full = bounded(saved(taken.groupBy(F.col("ball").alias("__b")).count().where("count > 1")
                             .select("__b"), "full"))
        parts.append(taken.join(full, F.col("ball") == F.col("__b"), "left_semi"))
        rest = met.join(full, near & (F.col("ball") == F.col("__b")), "left_anti")
        left = saved(rest.drop("off", "ball"), "left")
    out = left.withColumn("off", F.lit(0.0)).withColumn("ball", F.col("node"))
    for p in parts:
        out = out.unionByName(p)
    return out.drop("__cells")


def _candidates(members: DataFrame, balls: DataFrame, limit: float, tables: int, probes: int,
                scale: float, seed: int) -> DataFrame:
    """Pairs of balls (a < b) with members that meet in a cell, and centres that are not too far
    apart by their signs."""
    source = members.join(balls.select(F.col("ball").alias("__b"), "radius", "signs", "alone"),
                          F.col("ball") == F.col("__b")).select("ball", "radius", "signs", "alone", "unit")
    found = saved(_mapped(source, "own array<long>, near array<long>",
                          _lookups(tables, probes, scale, seed)).drop("unit"), "cells")

    def rows(cells: str, tag: str) -> DataFrame:
        each = found.select(F.explode(cells).alias(f"cell{tag}"), F.col("ball").alias(f"ball{tag}"),
                            F.col("radius").alias(f"radius{tag}"),
                            *[F.col("signs")[i].alias(f"sign{i}{tag}") for i in range(BITS // 64)], "alone")
        # several members of a ball may have one cell
        return each.where("alone").unionByName(each.where("not alone").distinct()).drop("alone")

    differ = sum((F.bit_count(F.col(f"sign{i}x").bitwiseXOR(F.col(f"sign{i}y")))
                  for i in range(BITS // 64)), F.lit(0))
    share = F.least(F.lit(1.0), (F.col("radiusx") + F.col("radiusy") + limit) / math.pi)
    most = BITS * share + SIGMAS * F.sqrt(BITS * share * (1 - share) + 1)
    return saved(
        rows("own", "x").hint("merge").join(rows("near", "y"), (F.col("cellx") == F.col("celly"))
                                            & (F.col("ballx") != F.col("bally")) & (differ <= most))
        .select(F.least("ballx", "bally").alias("a"), F.greatest("ballx", "bally").alias("b")).distinct(),
        "candidates")


def _links(members: DataFrame, balls: DataFrame, pairs: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links between balls: ``edges(a, b)``, and ``more(ball, node, n)``: rows linked to each node
    of a ball, or, where ``node`` is null, to every one."""
    limit = math.acos(cosine)
    side = lambda t, key: balls.select(
        F.col("ball").alias(key), *[F.col(c).alias(f"{c}_{t}") for c in ("unit", "radius", "weight")])
    met = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b")
    met = met.withColumn("cos", _dot(F.col("unit_a"), F.col("unit_b"))).withColumn("gap", _angle(F.col("cos")))
    reach = F.col("radius_a") + F.col("radius_b")
    every = F.when(reach == 0, F.col("cos") >= cosine).otherwise(F.col("gap") + reach <= limit - SURE)
    none = F.when(reach == 0, F.col("cos") < cosine).otherwise(F.col("gap") - reach > limit + SURE)
    met = saved(met.select("a", "b", "weight_a", "weight_b", every.alias("every"), none.alias("none"))
                .where("not none"), "met")
    both = met.select(F.col("a").alias("ball"), F.col("b").alias("other"),
                      F.col("weight_b").alias("n"), "every").unionByName(
        met.select(F.col("b").alias("ball"), F.col("a").alias("other"), F.col("weight_a").alias("n"), "every"))
    whole = both.where("every").select("ball", "other", F.lit(None).cast("long").alias("node"), "n")

    # members against the other centre
    centre = balls.select(F.col("ball").alias("__o"), F.col("unit").alias("__u"), "radius")
    one = (both.where("not every").select("ball", "other", F.col("n").alias("__n"))
           .join(members.select("ball", "node", "unit"), "ball")
           .join(centre, F.col("other") == F.col("__o"))
           .withColumn("gap", _angle(_dot(F.col("unit"), F.col("__u"))))
           .where(F.col("gap") - F.col("radius") <= limit + SURE)
           .withColumn("every", (F.col("gap") + F.col("radius") <= limit - SURE) & (F.col("radius") > 0))
           .drop("__o", "__u", "radius", "gap"))
    one = saved(one, "members")
    by_node = one.where("every").select("ball", "other", "node", F.col("__n").alias("n"))
    # and the few that are left, one by one
    each = (one.where("not every").select("ball", "other", "node", "unit")
            .join(members.select(F.col("ball").alias("other"), F.col("unit").alias("__u"), "weight"), "other")
            .where(_dot(F.col("unit"), F.col("__u")) >= cosine)
            .groupBy("ball", "other", "node").agg(F.sum("weight").alias("n")))
    more = saved(whole.unionByName(by_node).unionByName(each), "more")
    edges = more.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct()
    return edges, more.groupBy("ball", "node").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES,
                 scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """One row per row of ``rows``: its id, ``n_links`` (other rows found with this cosine or more),
    ``component_id`` (the smallest id reachable by links, its own included) and ``kept``, whether that
    is its own.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing,
    and so are vectors of different lengths. Copies, and vectors of one direction, are all linked. Equal
    ids stay separate rows; a null id is the component's only where no other is in it. Other columns
    are not looked at, an empty table gives no rows. ``cosine`` is over 0.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    limit = math.acos(cosine)
    given = rows.select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"))
    given = saved(_mapped(given, "unit array<double>, name binary", _units).drop("__v"), "units")
    nodes = given.where("name is not null").groupBy("name").agg(
        F.count("*").alias("weight"), F.min("__id").alias("least"), F.first("unit").alias("unit"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = saved(_balls(nodes, limit / 2, seed), "members")
    found = members.groupBy("ball").agg(
        F.max("off").alias("radius"), F.sum("weight").alias("weight"), F.min("least").alias("least"),
        (F.count("*") == 1).alias("alone"))
    centres = nodes.select(F.col("node").alias("ball"), "unit")
    balls = saved(_mapped(found.join(centres, "ball").select(
        "ball", "radius", "weight", "least", "alone", "unit"), "signs array<long>", _signs(seed)), "balls")
    pairs = _candidates(members, balls, limit, tables, probes, scale, seed)
    edges, more = _links(members, balls, pairs, cosine)

    grouped = components(edges)
    named = balls.select("ball", "weight", "least").join(
        grouped.withColumnRenamed("node", "__n"), F.col("ball") == F.col("__n"), "left").withColumn(
        "component", F.coalesce("component", "ball"))
    named = saved(named.select("ball", "weight", "least", "component"), "named")
    lowest = named.groupBy(F.col("component").alias("__c")).agg(F.min("least").alias("component_id"))
    to_all = more.where("node is null").select(F.col("ball").alias("__b"), F.col("n").alias("all_n"))
    to_one = more.where("node is not null").select(F.col("node").alias("__n"), F.col("n").alias("one_n"))
    known = (members.select(F.col("name").alias("__name"), "node", "ball")
             .join(named, "ball").join(lowest, F.col("component") == F.col("__c"))
             .join(to_all, F.col("ball") == F.col("__b"), "left")
             .join(to_one, F.col("node") == F.col("__n"), "left")
             .select("__name", "component_id", (F.col("weight") - 1 + F.coalesce("all_n", F.lit(0))
                                                + F.coalesce("one_n", F.lit(0))).alias("__links")))
    out = given.select("__id", "name").join(bounded(saved(known, "known")), F.col("name") == F.col("__name"), "left")
    none = F.col("__name").isNull()
    return out.select(
        F.col("__id").alias(id_col), F.when(none, 0).otherwise(F.col("__links")).cast("long").alias("n_links"),
        F.when(none, F.col("__id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                      **options) -> DataFrame:
    """The rows whose id is the smallest of their component."""
    kept = near_vectors(rows, id_col, vector_col, **options).where("kept").select(
        F.col(id_col).alias("__kept")).distinct()
    return rows.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")


def vector_report(rows: DataFrame) -> DataFrame:
    return near_vectors(rows)
