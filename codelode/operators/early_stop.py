"""Exact best n units per part, without the pairs that cannot be among them.

A unit becomes one row: its wanted stems by number, most frequent first in the numbering, and the
frequent ones as bits too. Against a part's bits they give what all frequent stems contribute, exactly,
by counting bits. The stems of a part are tried from the rarest on, and a unit that has one at place i
scores at most that plus the weights of the rare stems from i on: the block maxima of these stems. If this
is less than a score which n units are known to reach, the pair is never built.

That score, the threshold, comes from seeds: the units that hold the part's rarest stems, as many as
make a few times n. Frequent stems are looked up only where they alone could reach the threshold.

A pair is built at the first place at which it meets, and scored there in full from the two rows: no
shuffle and no sum of partial scores, only the best of each part and partition move on. The part side is
broadcast; callers check its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.sources.scratch import dealt, saved

UNIT_KEY = ["repo", "file", "start"]
PART_KEY = ["repo", "task_id", "part_no"]

#: Frequent stems of a repository that have a bit. More make bounds exact for more stems, and
#: rows wider.
FREQUENT = 512
WORD = 64
#: Seeds of a part: its rarest stems with so many times n holders.
SEEDS = 8


def _bit(id_: str) -> str:
    return f"shiftleft(1L, cast({id_} % {WORD} as int))"


def vocabulary(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, stem, id, df, most) of the wanted stems that occur: the id counts from the most
    frequent one, ``most`` is the largest weight. Saved; as many rows as wanted stems at most."""
    stems = wanted.select("repo", "stem").distinct()
    counts = index.join(F.broadcast(stems), ["repo", "stem"]).groupBy("repo", "stem").agg(
        F.count("*").alias("df"), F.max("weight").alias("most"))
    order = Window.partitionBy("repo").orderBy(F.desc("df"), "stem")
    return saved(counts.withColumn("id", F.row_number().over(order) - 1), "vocabulary")


def unit_rows(index: DataFrame, known: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """One row per unit with a wanted stem: ``rare`` and ``often``, the numbers of its stems (rarest
    first), ``named``, the rare ones in its name, and the frequent ones as bits (``b0`` ..), those in its
    name too (``n0`` ..). Nothing is moved when the index is bucketed by unit."""
    hits = index.join(F.broadcast(known.select("repo", "stem", "id")), ["repo", "stem"])
    words = range(-(-frequent // WORD))
    inside = lambda w: f"id >= {w * WORD} and id < {min(frequent, (w + 1) * WORD)}"
    bits = [F.expr(f"bit_or(if({inside(w)}{extra}, {_bit('id')}, 0L))").alias(f"{tag}{w}")
            for tag, extra in (("b", ""), ("n", " and weight > 1")) for w in words]
    return hits.groupBy(*UNIT_KEY).agg(*_numbers(frequent), F.collect_list(F.expr(
        f"if(id >= {frequent} and weight > 1, id, null)")).alias("named"), *bits)


def _numbers(frequent: int, prefix: str = "") -> list[Column]:
    """The rare and the frequent ones of the grouped numbers, each rarest first."""
    return [F.sort_array(F.collect_list(F.expr(f"if({test}, id, null)")), asc=False).alias(prefix + name)
            for name, test in (("rare", f"id >= {frequent}"), ("often", f"id < {frequent}"))]


def part_rows(wanted: DataFrame, known: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """One row per part: ``p_rare`` and ``p_often``, the numbers of its stems (rarest first), and the
    frequent ones as bits (``p0`` ..)."""
    words = range(-(-frequent // WORD))
    bits = [F.expr(f"bit_or(if(id >= {w * WORD} and id < {min(frequent, (w + 1) * WORD)}, {_bit('id')}, 0L))")
            .alias(f"p{w}") for w in words]
    return wanted.join(known, ["repo", "stem"]).groupBy(*PART_KEY).agg(*_numbers(frequent, "p_"), *bits)


def part_places(wanted: DataFrame, known: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """One row per stem of a part: its number, how many units have the stems before it (rarest
    first), and what the rare ones and all from it on can weigh."""
    order = Window.partitionBy(*PART_KEY).orderBy(F.desc("id"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = order.rowsBetween(0, Window.unboundedFollowing)
    rare = F.col("id") >= frequent
    return wanted.join(known, ["repo", "stem"]).select(
        *PART_KEY, "id", rare.alias("rare"), F.coalesce(F.sum("df").over(before), F.lit(0)).alias("before"),
        F.sum(F.when(rare, F.col("most")).otherwise(0.0)).over(left).alias("rare_left"),
        F.sum("most").over(left).alias("left"))


def met_pairs(units: DataFrame, parts: DataFrame, places: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Pairs of parts and units that meet at one of ``places`` (PART_KEY, id, rare, rare_left, least), each
    once, that can reach ``least``, with their exact ``score``."""
    words = range(-(-frequent // WORD))
    shared = F.expr(" + ".join(["0.0D", *(
        f"bit_count(b{w} & p{w}) + 0.5D * bit_count(n{w} & p{w})" for w in words)]))
    both = F.array_intersect("p_rare", "rare")
    bits = [f"{t}{w}" for t in "bn" for w in words]

    def meeting(ids: str, lists: list[str], here: DataFrame) -> DataFrame:
        exploded = units.select(*UNIT_KEY, *lists, *bits, F.explode(ids).alias("id"))
        known = parts.select(*PART_KEY, "p_rare", *[f"p_{x}" for x in lists if x == "often"], *[f"p{w}" for w in words])
        return (exploded.join(F.broadcast(here), ["repo", "id"]).join(F.broadcast(known), PART_KEY)
                .withColumn("common", shared))

    at_rare = meeting("rare", ["rare", "named"], places.where("rare").drop("rare"))
    at_rare = at_rare.where(F.col("rare_left") + F.col("common") >= F.col("least")).withColumn(
        "both", both).where(F.get("both", F.lit(0)) == F.col("id"))
    weight = F.size("both") + 0.5 * F.size(F.array_intersect("both", "named"))
    # a unit that has a rare stem of the part is met there
    at_often = meeting("often", ["rare", "often"], places.where("not rare").drop("rare", "rare_left"))
    at_often = at_often.where(F.col("common") >= F.col("least")).where(
        (F.size(both) == 0) & (F.get(F.array_intersect("p_often", "often"), F.lit(0)) == F.col("id")))
    scored = lambda rows, score: rows.select(*PART_KEY, "file", "start", score.alias("score"))
    return scored(at_rare, F.col("common") + weight).unionByName(scored(at_often, F.col("common")))


def candidates(wanted: DataFrame, index: DataFrame, n: int, frequent: int = FREQUENT,
               seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(pairs, seeds): scored pairs with every one that can be among the best ``n`` of its part, and
    the pairs that were scored for the threshold. ``index`` is read twice and should be stored;
    its weights are 1, or 1.5 for a stem of the name."""
    wanted = saved(wanted, "wanted")
    known = vocabulary(wanted, index)
    units = dealt(saved(unit_rows(index, known, frequent), "unit_stems"))
    parts = saved(part_rows(wanted, known, frequent), "part_stems")
    places = saved(part_places(wanted, known, frequent), "places")

    early = places.where(F.col("before") < seeds * n).withColumn("least", F.lit(0.0))
    tried = met_pairs(units, parts, early.drop("before", "left"), frequent)
    order = Window.partitionBy(*PART_KEY).orderBy(F.desc("score"))
    reached = (tried.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
               .groupBy(*PART_KEY).agg(F.min("score").alias("_least"), F.count("*").alias("_of")))
    least = saved(reached.where(F.col("_of") == n).drop("_of"), "thresholds")

    from_here = places.join(F.broadcast(least), PART_KEY, "left").withColumn(
        "least", F.coalesce("_least", F.lit(0.0)))
    wide = from_here.where(F.col("left") >= F.col("least")).drop("before", "left", "_least")
    return met_pairs(units, parts, wide, frequent), tried
