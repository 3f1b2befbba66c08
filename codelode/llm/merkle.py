"""Merkle manifest of a dataset, with incremental witnesses.

Rows become leaves; the leaves of a group, in order, make a tree whose nodes are the hashes of up to
eight hashes below. The groups' roots make one more tree. What a leaf needs to be folded up to the root
again, its witness, is the hashes of its siblings level by level.

A tree grows by append only. An open run of siblings holds its subtrees, each with a partial witness
of that level; a subtree that completes later extends those of the subtrees before it, and starts with
their hashes. So a witness is whole when its run closes, and no tree is read twice. Leaves are
streamed in blocks of 4,096, each by one task; blocks are aligned, so their roots are appended to a
tree of blocks in the same way, and again, until one is left. Only block roots and their witnesses,
one row per block, go from one step to the next.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codelode.llm.common import bounded
from codelode.sources.scratch import saved

#: Children of a node.
ARITY = 8
#: Levels of a tree that one task builds: a block has ARITY ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 4
#: Characters of a digest.
DIGEST = 64
WITNESS = "places array<int>, siblings array<string>"


def field_text(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


class Appender:
    """A tree that grows leaf by leaf. ``witness[i]`` lists (place, siblings) of leaf ``i``, the
    lowest level first; ``siblings`` are the hashes of the others of its run, joined."""

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        #: per level the subtrees of the open run: digest, first leaf, partial witness of the level
        self.open: list[list[tuple[str, int, list[str]]]] = [[]]
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._complete(0, digest, len(self.witness) - 1)

    def _complete(self, level: int, digest: str, first: int) -> None:
        """The subtree of ``digest`` is complete: it extends the partial witnesses of its run."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for _, _, partial in run:
            partial.append(digest)
        run.append((digest, first, [d for d, _, _ in run]))
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run = self.open[level]
        ends = [first for _, first, _ in run[1:]] + [self._end(level)]
        for place, ((_, first, partial), end) in enumerate(zip(run, ends, strict=True)):
            step = (place, "".join(partial))
            for leaf in range(first, end):
                self.witness[leaf].append(step)
        parent = sha256("".join(d for d, _, _ in run).encode()).hexdigest()
        self.open[level] = []
        self._complete(level + 1, parent, run[0][1])

    def _end(self, level: int) -> int:
        """First leaf that is not below the open run of ``level``: that of the run below it."""
        below = [run[0][1] for run in self.open[:level] if run]
        return min(below, default=len(self.witness))

    def finish(self, levels: int | None = None) -> str:
        """Close the open runs, to one node or to exactly ``levels`` levels; the root's digest."""
        level = 0
        while True:
            run, last = self.open[level], level + 1 == len(self.open)
            if run and (level == levels or (levels is None and last and len(run) == 1)):
                return run[0][0]
            if run:
                self._close(level)
            level += 1


def _block(table: pa.Table, arity: int, levels: int) -> tuple[pa.Table, Appender, str]:
    """A block's rows in order, the tree over them and its root. A block that is a whole tree ends
    with one node; others are lifted to the level of blocks, even short ones."""
    table = table.sort_by("__pos")
    tree = Appender(arity)
    for digest in table.column("__digest").to_pylist():
        tree.append(digest)
    alone = table.column("__n")[0].as_py() <= arity ** levels
    return table, tree, tree.finish(None if alone else levels)


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The blocks of ``nodes`` (``__tree``, ``__pos``, ``__digest``, ``__n`` nodes in the tree, and
    others), as the nodes of a tree of their own."""
    width = arity ** levels

    def roots(table: pa.Table) -> pa.Table:
        table, _, digest = _block(table, arity, levels)
        n = -(-table.column("__n")[0].as_py() // width)
        return pa.table({"__tree": table.column("__tree")[:1], "__pos": table.column("__block")[:1],
                         "__digest": [digest], "__n": [n]})

    own = nodes.select("__tree", "__pos", "__digest", "__n", F.expr(f"__pos div {width}").alias("__block"))
    return saved(own.groupBy("__tree", "__block").applyInArrow(
        roots, "__tree long, __pos long, __digest string, __n long"), "blocks")


def _witnessed(nodes: DataFrame, above: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` with ``places`` and ``siblings`` (lowest level first), those that ``above`` has for
    the block included, and the other columns of ``above`` (``__tree``, ``__pos`` of the block)."""
    new = StructType([f for f in above.schema.fields if f.name not in ("__tree", "__pos")])
    types = to_arrow_schema(new)
    above = above.withColumnRenamed("__pos", "__block")

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        left, tree, _ = _block(left, arity, levels)
        rest = {f.name: right.column(f.name)[0].as_py() for f in types}
        n = len(tree.witness)
        columns = {name: [value] * n for name, value in rest.items()} | {
            "places": [[p for p, _ in w] + rest["places"] for w in tree.witness],
            "siblings": [[s for _, s in w] + rest["siblings"] for w in tree.witness]}
        out = left.drop_columns(["__block"])
        for f in types:
            out = out.append_column(f, pa.array(columns[f.name], type=f.type))
        return out

    keyed = nodes.withColumn("__block", F.expr(f"__pos div {arity ** levels}"))
    return keyed.groupBy("__tree", "__block").cogroup(
        above.groupBy("__tree", "__block")).applyInArrow(
            extended, StructType([*nodes.schema.fields, *new.fields]))


def _grown(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``__tree``, ``__pos``, ``places``, ``siblings`` and ``root`` of saved ``nodes``."""
    if (nodes.agg(F.max("__n")).first()[0] or 0) <= 1:
        return nodes.select("__tree", "__pos", F.array().cast("array<int>").alias("places"),
                            F.array().cast("array<string>").alias("siblings"),
                            F.col("__digest").alias("root"))
    above = _grown(_blocks(nodes, arity, levels), arity, levels)
    return saved(_witnessed(nodes, above, arity, levels).drop("__digest", "__n"), "witnesses")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Saved ``rows`` with a number from 0 in the given order, by key ranges: no task sorts more than
    its range. ``rows`` are read twice and should be saved, ``order`` tell all rows apart."""
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("__m", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__m", 33)
    at, starts = 0, []
    # one row per partition, whatever the number of rows
    for r in sorted(ranged.groupBy(part.alias("p")).count().collect()):
        starts.append((r["p"], at))
        at += r["count"]
    shifts = rows.sparkSession.createDataFrame(starts, "__p long, __from long")
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(F.broadcast(shifts), part == F.col("__p"))
            .withColumn(name, inside + F.col("__from")).drop("__m", "__p", "__from"))


def manifest(rows: DataFrame, leaf: Column, group: Column, order: list[Column],
             arity: int = ARITY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``rows`` with ``leaf``, ``subroot`` (of the group's tree), ``root`` and the witness up to the
    root: ``places`` (where a hash stands in its run, level by level) and ``siblings`` (the others of
    the run, joined from left to right; nothing for a run of one).

    A null group is a group like any other and comes first. Rows with an equal order are told apart by
    their leaves, and equal leaves are interchangeable. A lone leaf is its group's root and a lone
    group's root the root, with a witness of no levels. An empty table gives no rows. Columns of
    ``rows`` with the names of new ones are replaced; the others, which should be narrow, move along.
    Texts of any length are hashed where they lie.
    """
    new = ("leaf", "subroot", "root", "places", "siblings")
    kept = [c for c in rows.columns if c not in new]
    leaves = saved(rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), leaf.alias("__digest"),
        group.alias("__group"), *[c.alias(f"__order{i}") for i, c in enumerate(order)],
        F.monotonically_increasing_id().alias("__id")), "leaves")
    by = ["__group", *[f"__order{i}" for i in range(len(order))], "__digest", "__id"]
    leaves = numbered(leaves, by, "__at").drop("__id", *by[1:-2])
    groups = numbered(saved(leaves.groupBy("__group").agg(
        F.min("__at").alias("__first"), F.count("*").alias("__n")), "groups"), ["__group"], "__tree")
    groups = bounded(saved(groups.withColumnRenamed("__group", "__g"), "groups"))
    nodes = leaves.join(groups, F.col("__group").eqNullSafe(F.col("__g"))).select(
        "__row", "__tree", (F.col("__at") - F.col("__first")).alias("__pos"), "__digest", "__n")
    nodes = saved(nodes, "nodes")
    above = _grown(_blocks(nodes, arity, levels), arity, levels)
    subroots = above.where("__pos = 0").select(
        F.lit(0).cast("long").alias("__tree"), F.col("__tree").alias("__pos"),
        F.col("root").alias("__digest"), F.lit(groups.count()).cast("long").alias("__n"))
    top = _grown(saved(subroots, "subroots"), arity, levels).select(
        F.col("__pos").alias("__t"), F.col("places").alias("__places"),
        F.col("siblings").alias("__siblings"), F.col("root").alias("__top"))
    above = above.join(bounded(saved(top, "top"), 20_000), F.col("__tree") == F.col("__t")).select(
        "__tree", "__pos", F.concat("places", "__places").alias("places"),
        F.concat("siblings", "__siblings").alias("siblings"), F.col("root").alias("subroot"),
        F.col("__top").alias("root"))
    return _witnessed(nodes, above, arity, levels).select(
        "__row.*", F.col("__digest").alias("leaf"), "subroot", "root", "places", "siblings")


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and a witness."""
    step = lambda own, s: F.sha2(F.concat(
        F.substr(s["siblings"], F.lit(1), s["places"] * DIGEST), own,
        F.substr(s["siblings"], s["places"] * DIGEST + 1)), 256)
    return F.aggregate(F.arrays_zip(places.alias("places"), siblings.alias("siblings")), leaf, step)


def proof_hash(siblings: Column) -> Column:
    return F.sha2(F.array_join(siblings, ""), 256)


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and what becomes of it when the texts of every third
    document lose their capitals."""
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = leaf_hash(*fields(F.col("text")))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text", F.when(
        tampered, leaf_hash(*fields(small))).alias("__changed"))
    made = manifest(rows.select("doc_id", "lang", "__changed", leaf.alias("__leaf")), F.col("__leaf"),
                    F.col("lang"), [F.col("doc_id")])
    found = folded(F.coalesce("__changed", "leaf"), F.col("places"), F.col("siblings"))
    return made.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("siblings"))
                       .alias("proof_sha256"), found.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
