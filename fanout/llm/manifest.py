"""A Merkle manifest of a table: a tree of digests a group of rows, and one tree over the groups' roots.

Levels are built by a slot pivot. A node's place among its tree's nodes says its parent (place div FANOUT) and its slot
there (the rest); grouping by parent, one conditional aggregate a slot spreads the children into FANOUT columns.
Concatenated, the columns hash to the parent; without the child's own slot they are its siblings.

Nodes meet in blocks of FANOUT ** LEVELS neighbours: one exchange serves LEVELS pivots, however large the tree, and no
task takes more than a block of any tree at once. What a block's pivots found is kept as one nested row, so the way down,
which hands every node its siblings from there to the root, opens it again without another exchange: only
one row a block meets the path from above it. Digests are lower-case hex, hashed as text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout.llm.shared import importable, written
from fanout.operators.ordering import rank_within

FANOUT = 3
LEVELS = 4
SLOTS = range(FANOUT)

#: the path of a root: no siblings
NO_PATH = "cast(array() as array<struct<before: string, after: string>>)"


def sha256(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, ``-`` where it is null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return sha256(*parts)


def _pivots(nodes: DataFrame) -> DataFrame:
    """LEVELS levels above (tree, place, node), a row a block, its node holding all it was made of.

    A node is (digest, item) at the bottom and (digest, alone, kids) above: ``alone`` marks a run that is the whole of its
    level, so its one node is the root already and is not hashed again.
    """
    level = nodes.withColumn("block", F.expr(f"place div {FANOUT**LEVELS}")).repartition("tree", "block")
    for _ in range(LEVELS):
        slot = F.pmod("place", F.lit(FANOUT))
        spread = level.groupBy("tree", "block", F.expr(f"place div {FANOUT}").alias("parent")).agg(
            *[F.max(F.when(slot == k, F.col("node"))).alias(f"c{k}") for k in SLOTS]
        )
        alone = (F.col("parent") == 0) & F.col("c1").isNull()
        joint = sha256(*[F.coalesce(F.col(f"c{k}.digest"), F.lit("")) for k in SLOTS])
        level = spread.select(
            "tree",
            "block",
            F.col("parent").alias("place"),
            F.struct(
                F.when(alone, F.col("c0.digest")).otherwise(joint).alias("digest"),
                alone.alias("alone"),
                F.array(*[f"c{k}" for k in SLOTS]).alias("kids"),
            ).alias("node"),
        )
    return level.select("tree", "place", "node")


def _grown(leaves: DataFrame) -> list[DataFrame]:
    """Tables of pivots from (tree, place, digest, item) up, until every tree has one node."""
    tables, nodes = [], leaves.select("tree", "place", F.struct("digest", "item").alias("node"))
    while True:
        tables.append(written(_pivots(nodes), "pivots"))
        if tables[-1].filter("place > 0").isEmpty():
            return tables
        # in the next table a block stands for its place alone
        nodes = tables[-1].select("tree", "place", F.struct("node.digest", F.col("place").alias("item")).alias("node"))


def _opened(blocks: DataFrame, paths: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The bottom of a table of pivots: every node's digest, item and path, siblings next to it first."""
    rows = blocks.join(paths, ["tree", "place"]).drop("place")
    for _ in range(LEVELS):
        kids = [F.col("node.kids")[k] for k in SLOTS]
        digests = [F.coalesce(kid["digest"], F.lit("")) for kid in kids]
        spread = F.array(
            *[
                F.struct(
                    kids[k].alias("kid"),
                    reduce(F.concat, digests[:k], F.lit("")).alias("before"),
                    reduce(F.concat, digests[k + 1 :], F.lit("")).alias("after"),
                )
                for k in SLOTS
            ]
        )
        rows = rows.select("tree", *carried, "path", F.col("node.alone").alias("alone"), F.inline(spread))
        nearer = F.concat(F.array(F.struct("before", "after")), F.col("path"))
        rows = rows.filter("kid is not null").select(
            "tree", *carried, F.when(F.col("alone"), F.col("path")).otherwise(nearer).alias("path"), F.col("kid").alias("node")
        )
    return rows.select("tree", *carried, "path", "node.digest", "node.item")


def _descended(tables: list[DataFrame], paths: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(tree, digest, item, path) of every leaf, with what each tree's root carries."""
    for k, table in enumerate(reversed(tables)):
        found = _opened(table, paths, carried)
        if k == len(tables) - 1:
            return found
        paths = written(found.select("tree", F.col("item").alias("place"), *carried, "path"), "paths")
    raise ValueError("no tables")


def manifest(
    rows: DataFrame, fields: Sequence[str], group: str, order: str, kept: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``rows``: ``order``'s column, leaf, subroot, root, path, and the columns of ``kept``.

    ``group`` deals rows to trees, whose leaves ascend by ``order`` (nulls first, then by digest, so repeated rows have
    a defined place); trees are ordered by ``group``, null first, UTF-8 bytewise. ``path`` lists, from the leaf to
    the root, the digests before and after the node in its run, joined. ``kept`` are expressions over ``rows``, such
    as other leaves; their names must not be tree, place, digest, item or those of the result. Columns not named are
    not read. A null counts as a value of its own, texts of any length are hashed where they stand, and an empty
    table gives no rows. Runs when called; only digests and ``order`` are shuffled.
    """
    importable(rows.sparkSession)
    kept = kept or {}
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    narrow = rows.select(
        tree.alias("tree"),
        leaf([F.col(f) for f in fields]).alias("digest"),
        F.struct(F.col(order).alias("order"), *[e.alias(n) for n, e in kept.items()]).alias("item"),
    )
    placed = rank_within(narrow, ["tree"], F.col("item.order"), [F.col("digest")], "rank")
    tables = _grown(placed.withColumn("place", F.col("rank") - 1))

    subroots = tables[-1].select(
        F.lit("all").alias("trees"), F.struct("tree", F.col("node.digest").alias("subroot")).alias("item")
    )
    ranked = rank_within(subroots, ["trees"], F.col("item.tree"), [], "rank")
    above = _grown(
        ranked.select(
            F.col("trees").alias("tree"),
            (F.col("rank") - 1).alias("place"),
            F.col("item.subroot").alias("digest"),
            F.col("item.tree").alias("item"),
        )
    )
    root = above[-1].select("tree", "place", F.expr(NO_PATH).alias("path"), F.col("node.digest").alias("root"))
    tops = _descended(above, root, ["root"]).select(
        F.col("item").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"
    )
    leaves = _descended(tables, written(tops, "subroots"), ["subroot", "root"])
    return leaves.select(
        F.col("item.order").alias(order),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        *[F.col(f"item.{n}").alias(n) for n in kept],
    )


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda below, p: sha256(p["before"], below, p["after"]))


def verified(rows: DataFrame, other: Column, path: str = "path", root: str = "root") -> DataFrame:
    """``rows`` of a manifest with ``folded_root`` from the digests of ``other``, and whether it is the root."""
    return rows.withColumn("folded_root", folded(other, F.col(path))).withColumn(
        "verified", F.col("folded_root") == F.col(root)
    )
