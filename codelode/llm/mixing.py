"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target fixes how many copies of its documents are expected in all; a document's share goes by
its weight, which is the number of its words up to a length, in steps: a few words say little. No
document is expected more often than a bound, so the rate per weight rises until the target is met. The
whole part of what is expected is certain. The rest is an inclusion probability: documents are ranked by
the odds of a fixed random number divided by the odds of inclusion, and the first ones are taken until
the words still wanted are reached (to the nearest document). That is a sample of fixed size, in words,
with unequal probabilities.

No source is sorted in one task: ranks are cut into cells, cells are summed before the shuffle, and
only the cell in which the wanted words run out is put in order. What is kept of that is one row
per source, so the documents themselves are read once more and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.llm.common import WORD, bounded
from codelode.sources.scratch import saved

#: Times a source, and a document, can be repeated.
MOST_COPIES = 3
#: Weights of the sources in order, from the first again after the last.
WEIGHTS = (1, 2, 3)
#: Words from which a document has the full weight, and words of a step of weight.
FULL_WORDS, STEP_WORDS = 200, 20
#: Parts that the ranks of a source are cut into, at least, and documents of one, about.
CELLS, CELL_ROWS = 4096, 2000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_weight(size: Column) -> Column:
    """Weight of a document by its words: 0 without any, 1 to 10 in steps."""
    return F.ceil(F.least(size, F.lit(FULL_WORDS)) / float(STEP_WORDS)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: the weights, in the order of the
    sources' code points with null last, share all words; a source gets ``most`` times its size at
    most and the rest is shared among the others by weight. The sources that hit the bound are the
    first ones by size per weight, so the share of the others follows from running sums. One row
    per source: these are few."""
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                                 F.pmod(F.row_number().over(Window.orderBy(
                                     F.col("source").asc_nulls_last())) - 1,
                                        F.lit(len(WEIGHTS))).cast("int") + 1)
    weighed = sizes.withColumn("weight", weights.cast("long"))
    ratio = F.col("source_size") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    prior = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    shared = (weighed.withColumn("total", total)
              .withColumn("bounded", F.coalesce(F.sum(most * F.col("source_size")).over(prior), F.lit(0)))
              .withColumn("weights", F.sum("weight").over(rest)))
    # the share per weight if exactly the sources before this one are at their bound
    left, weights = F.col("total") - F.col("bounded"), F.col("weights")
    free = most * F.col("source_size") * weights >= left * F.col("weight")
    first = F.min(F.when(free, F.struct("place", "left", "weights"))).over(Window.partitionBy())
    placed = (shared.withColumn("left", left).withColumn("place", F.row_number().over(by_ratio))
              .withColumn("first", first))
    target = F.when(F.col("place") < F.col("first.place"),
                    (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("first.left")).cast("double")
        / F.col("first.weights").cast("double"))
    return placed.select("source", "source_size", target.alias("target"))


def rates(sources: DataFrame, sized: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` with ``rate``, the copies expected per unit of weight: the heaviest documents are at
    the bound and the others share the rest of the target by weight. Null where all are at the bound.
    Weights are few whole numbers, so a source has few rows here."""
    levels = saved(sized.where(F.col("__weight") > 0).groupBy("__source", "__weight").agg(
        F.sum("__size").alias("words")), "weights")
    targets = sources.select(F.col("source").alias("__s"), "target")
    heavy = Window.partitionBy("__source").orderBy(F.desc("__weight"))
    above = F.coalesce(F.sum("words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("__weight")).over(
        heavy.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = (levels.join(bounded(targets), F.col("__source").eqNullSafe(F.col("__s")))
             .withColumn("rate", (F.col("target") - (most * above).cast("double")) / below.cast("double"))
             .where(F.col("rate") * F.col("__weight") <= most))
    best = tried.groupBy(F.col("__source").alias("__r")).agg(F.max_by("rate", "__weight").alias("rate"))
    return sources.join(bounded(saved(best, "rates")), F.col("source").eqNullSafe(F.col("__r")), "left").drop("__r")


def _ranked(docs: DataFrame, sources: DataFrame, seed: int, most: int) -> DataFrame:
    """Certain copies, inclusion probability, rank and cell of each document."""
    joined = docs.join(sources.select(F.col("source").alias("__key"), "source_size", "rate", "target",
                                      "cells"), F.col("__source").eqNullSafe(F.col("__key")))
    expected = F.when(F.col("__weight") == 0, 0.0).when(F.col("rate").isNull(), float(most)).otherwise(
        F.least(F.lit(float(most)), F.col("rate") * F.col("__weight")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("__id").cast("string"),
                                                                  F.lit("null"))))
    random = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    chance = F.col("__chance")
    usual = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    mean = F.greatest(F.lit(0.001), F.least(F.lit(0.999), usual - F.floor(usual)))
    scaled = F.col("__rank") * (mean / (1 - mean))
    return (joined.withColumn("__expected", expected)
            .withColumn("__whole", F.floor("__expected").cast("long"))
            .withColumn("__chance", F.col("__expected") - F.col("__whole"))
            .withColumn("__random", random)
            .withColumn("__rank", F.when(chance > 0, (F.col("__random") / (1 - F.col("__random")))
                                         / (chance / (1 - chance))))
            .withColumn("__cell", F.floor(scaled / (1 + scaled) * F.col("cells")).cast("int")))


def _prepared(docs: DataFrame, id_col: str, source_col: str, text_col: str,
              weight_col: str | None) -> DataFrame:
    size = n_words(F.col(text_col))
    weight = word_weight(size) if weight_col is None else F.when(size > 0, F.greatest(
        F.coalesce(F.col(weight_col), F.lit(0)), F.lit(0))).otherwise(0)
    return docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": size,
                             "__weight": weight.cast("long")})


def mixture(sized: DataFrame, seed: int = 7, most: int = MOST_COPIES) -> DataFrame:
    """One row per source with what decides on its documents: size, target, the cell in which its
    words run out (``cut_cell``) and the last document taken there (``cut``)."""
    sizes = saved(sized.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"), F.count("*").alias("rows")), "source-sizes")
    cells = max(CELLS, (sizes.agg(F.max("rows")).first()[0] or 0) // CELL_ROWS)
    targets = saved(source_targets(sizes.drop("rows"), most), "targets")
    sources = saved(rates(targets, sized, most).withColumn("cells", F.lit(cells)), "sources")
    ranked = _ranked(sized, bounded(sources), seed, most)
    cells = saved(ranked.groupBy(F.col("__key").alias("source"), F.coalesce("__cell", F.lit(-1)).alias("cell")).agg(
        F.sum(F.when(F.col("__rank").isNotNull(), F.col("__size")).otherwise(0)).alias("words"),
        F.sum(F.col("__whole") * F.col("__size")).alias("whole")), "cells")
    by_cell = Window.partitionBy("source").orderBy("cell")
    sums = (cells.withColumn("before", F.coalesce(
        F.sum("words").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("whole", F.sum("whole").over(Window.partitionBy("source"))))
    wanted = sources.select(F.col("source").alias("__s"), "target")
    cut = (sums.join(bounded(wanted), F.col("source").eqNullSafe(F.col("__s")))
           .withColumn("rest", F.col("target") - F.col("whole"))
           .where((F.col("before") <= F.col("rest")) & (F.col("cell") >= 0))
           .groupBy("source").agg(F.max_by(F.struct("cell", "before", "rest"), "cell").alias("c"))
           .select(F.col("source").alias("__s"), "c.*"))
    cut = saved(cut, "cuts")
    last = Window.partitionBy("__key").orderBy("__rank", "__id", "__size").rowsBetween(
        Window.unboundedPreceding, -1)
    edge = (ranked.join(bounded(cut), F.col("__key").eqNullSafe(F.col("__s"))
                        & (F.col("__cell") == F.col("cell")))
            .withColumn("before", F.col("before") + F.coalesce(F.sum("__size").over(last), F.lit(0)))
            .where(F.col("before") + F.col("__size") / 2.0 <= F.col("rest"))
            .groupBy(F.col("__key").alias("__e"))
            .agg(F.max(F.struct("__rank", "__id", "__size")).alias("cut")))
    edge = saved(edge, "edges")
    plan = (sources.join(cut.select("__s", F.col("cell").alias("cut_cell")),
                         F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
            .join(edge, F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e"))
    return saved(plan, "mixture")


def mix(docs: DataFrame, plan: DataFrame | None = None, seed: int = 7, most: int = MOST_COPIES,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weight_col: str | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, which replace columns of
    these names.

    A null text has no words; documents without words take nothing but keep their row. Null is a
    source of its own, the last one. A document's weight is that of its words (``word_weight``), or
    ``weight_col``, which holds few different whole numbers (null: 0). If all documents with a weight
    are taken as often as the bound allows, a source can stay below its target. Equal ids draw the same random number, so repeated rows
    are taken alike. A source without words has target 0. Reruns agree: the random numbers are
    digests of the ids. An empty table gives no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    columns = docs.columns
    sized = _prepared(docs, id_col, source_col, text_col, weight_col)
    if plan is None:
        plan = mixture(saved(sized.select("__id", "__source", "__size", "__weight"), "sized"),
                       seed, most)
    return _decided(sized, plan, seed, most).select(
        *[F.col(f"`{c}`") for c in columns], F.col("__size").alias("size"), "source_size",
        "target", "copies")


def _decided(sized: DataFrame, plan: DataFrame, seed: int, most: int) -> DataFrame:
    ranked = _ranked(sized, bounded(plan.select("source", "source_size", "rate", "target", "cells")),
                     seed, most)
    cuts = plan.select(F.col("source").alias("__p"), "cut_cell", "cut")
    at = F.struct("__rank", "__id", "__size")
    taken = (F.col("__cell") < F.col("cut_cell")) | (
        (F.col("__cell") == F.col("cut_cell")) & (at <= F.col("cut")))
    return ranked.join(bounded(cuts), F.col("__key").eqNullSafe(F.col("__p"))).withColumn(
        "copies", F.col("__whole") + F.coalesce(taken, F.lit(False)).cast("long"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says."""
    return mixed.where(F.col("copies") > 0).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")


def mix_report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """What the mix takes of each document. Sizes are counted once and kept as narrow rows."""
    sized = saved(_prepared(docs, "doc_id", "source", "text", None)
                  .select("__id", "__source", "__size", "__weight"), "sized")
    decided = _decided(sized, mixture(sized, seed), seed, MOST_COPIES)
    return decided.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
        (F.col("copies") * F.col("__size")).alias("taken"), F.col("__weight").alias("weight"),
        F.col("__chance").alias("chance"))
