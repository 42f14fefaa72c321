"""Which sets of tokens link: exact Jaccard from a threshold on, without pairs inside a merged group.

``entries`` say which sets could link: two sets at or above the threshold share a key. Keys that only one
set has are dropped by a grouped count, and sets whose size or rest lets them link with no other one of
their key leave it. Keys that the same sets share after that are one. Sets that share a key then meet by
their bitmaps in signature trees, block by block, and as many pairs as connect all that may link become
edges. The components of
those edges are families: every link lies inside one. Families are cut to smaller ones in the same way by
wider bitmaps, and only what is still in one is built whole. A family goes to tasks in blocks of bounded
size; each block is linked exactly by its trees, and then block against block, where what is connected
already is not compared again. No pair becomes a row unless it connects two sets or components that
nothing connected before, so rows stay as few as sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout.llm import signature_tree as st
from fanout.llm.components import components
from fanout.llm.shared import discard, freed, likely, small, written
from fanout.llm.words import mixed, unpacked

MEETING_TOKENS = 8_000_000  # of sets that meet by bitmaps in one block: half a megabyte
NEIGHBOURS = 8  # by size, that a set of a key is held against one by one; with more, it stays
BLOCK_TOKENS = 8_000_000  # of whole sets in a block: 64 MB
LINK_NAMES = ["a", "b"]
LINKS = "a bigint, b bigint"
SETS = "id bigint, values binary"


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first ``keys`` columns; such a group may span batches."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[-1][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _batches(pairs: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    pairs = iter(pairs)
    while part := list(islice(pairs, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], LINK_NAMES)


def _linking(keys: int, num: int, den: int):
    """Links within each group of rows that agree in their first ``keys`` columns, verified on whole sets.

    Rows go on with: side, id, component, rest, values. Rows of both sides meet across; of one side, with each other.
    A pair that links or components connect already is not verified.
    """

    def one(group: list[tuple]) -> Iterator[tuple[int, int]]:
        if len(group) < 2:
            return
        sides, ids, components, rest, data = zip(*(r[keys:] for r in group), strict=True)
        values = [unpacked(v) for v in data]
        s = st.Sets(ids, [len(v) for v in values], [st.bitmap(v, st.FINE) for v in values], components, rest)
        joined = st.Joining(s)
        for i, j in _candidates(s, sides, num, den):
            if joined.apart(i, j) and st.reaches(values[i], values[j], num, den):
                joined.join(i, j)
                if ids[i] != ids[j]:
                    yield ids[i], ids[j]

    return lambda batches: _batches(p for g in runs(batches, keys) for p in one(g))


def _candidates(s: st.Sets, sides, num: int, den: int) -> Iterator[tuple[int, int]]:
    at, right = np.arange(len(s.ids)), np.array(sides)
    if right.any() and not right.all():
        return st.candidates(s, s.tree(at[~right]), s.tree(at[right]), num, den)
    tree = s.tree(at)
    return st.candidates(s, tree, tree, num, den)


def _may_reach(x: tuple, y: tuple, num: int, den: int) -> bool:
    """The signature trees' test for two sets of one bitmap width; rows as in ``_meeting``."""
    nx, ny = x[6], y[6]
    if nx * den < num * ny or ny * den < num * nx or min(x[5], y[5]) * (num + den) < num * (nx + ny):
        return False
    p, q = int.from_bytes(x[7], "little"), int.from_bytes(y[7], "little")
    most = min(nx - p.bit_count(), ny - q.bit_count()) + (p & q).bit_count()
    return most * (num + den) >= num * (nx + ny)


def _edges(num: int, den: int):
    """Pairs that may reach the threshold by their bitmaps, as many as connect all such pairs of a group.

    Rows: key, block, other block, side, id, rest, size, bitmap.
    """

    def one(group: list[tuple]) -> Iterator[tuple[int, int]]:
        own = group[0][1] == group[0][2]
        if len(group) < 2 or not (own or len({r[3] for r in group}) == 2):
            return
        if len(group) == 2 and len(group[0][7]) == len(group[1][7]):
            if _may_reach(*group, num, den):
                yield group[0][4], group[1][4]
            return
        *_, sides, ids, rest, sizes, bits = zip(*group, strict=True)
        s = st.Sets(ids, sizes, [unpacked(b) for b in bits], range(len(group)), rest)
        joined = st.Joining(s)
        for i, j in _candidates(s, sides, num, den):
            if joined.apart(i, j):
                joined.join(i, j)
                yield ids[i], ids[j]

    return lambda batches: _batches(p for g in runs(batches, 3) for p in one(g) if p[0] != p[1])


def _met(rows: DataFrame, key: str, blocks: Column, *columns: Column | str) -> DataFrame:
    """Rows of each key dealt to pairs of its blocks: key, i, j, side and the columns, in that order by task."""
    return (
        rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .select(
            F.col(key).alias("key"),
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).alias("side"),
            *columns,
        )
    )


def _by_pair_of_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _with_partner(keys: np.ndarray, sizes: np.ndarray, rest: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows that may link with another one of their key, by sizes and rests. Rows come by key, then size."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(starts, len(keys)))
    may = np.repeat(counts > NEIGHBOURS + 1, counts)
    for step in range(1, min(NEIGHBOURS + 1, len(keys))):
        x, y = slice(None, -step), slice(step, None)
        fits = (keys[x] == keys[y]) & (sizes[x] * den >= num * sizes[y])
        fits &= np.minimum(rest[x], rest[y]) * (num + den) >= num * (sizes[x] + sizes[y])
        may[x] |= fits
        may[y] |= fits
    return may


def _shared_lists(num: int, den: int):
    """The rows of each key that may link, under a key that the same ids have wherever they share one.

    Two lists that collide under one key only meet in vain.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            members = groups.flatten()
            counts = groups.value_lengths().to_numpy(zero_copy_only=False)
            keys = np.repeat(np.arange(len(counts)), counts)
            sizes, ids, rest = (members.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((sizes, keys))
            order = order[_with_partner(keys[order], sizes[order], rest[order], num, den)]
            if not len(order):
                continue
            keys, ids, rest = keys[order], ids[order], rest[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sums = np.add.reduceat(mixed(ids.view(np.uint64)), starts)
            named = np.repeat(mixed(sums, 1), np.diff(np.append(starts, len(keys)))).view(np.int64)
            columns = [pa.array(named), pa.array(ids), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "rest"])

    return run


def _live(entries: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """key, id, rest and the key's tokens, of sets that may link by a key.

    Keys of one block are read whole, a list a key, as the join leaves them; those of more keep all their sets.
    """
    one = F.col("tokens") <= MEETING_TOKENS
    few, many = shared.filter(one), shared.filter(~one)
    lists = likely(entries, "key", few).join(few, "key").groupBy("key").agg(F.collect_list(F.struct("n", "id", "rest")).alias("of"))
    lists = lists.select("of").mapInArrow(freed(_shared_lists(num, den)), "key bigint, id bigint, rest bigint")
    lists = lists.groupBy("key", "id").agg(F.max("rest").alias("rest")).withColumn("tokens", F.lit(1).cast("bigint"))
    rows = likely(entries, "key", many).join(many, "key").select("key", "id", "rest", "tokens")
    return written(lists.union(rows), "live")


def _meeting(live: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    blocks = F.ceil(F.col("tokens") / MEETING_TOKENS)
    met = _met(live.join(signatures, "id"), "key", blocks, "id", "rest", "n", "bits")
    return _by_pair_of_blocks(met).mapInArrow(freed(_edges(num, den)), LINKS).distinct()


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [unpacked(v) for v in batch.column(1).to_pylist()]
        maps = pa.array([st.bitmap(v, st.FINE).tobytes() for v in values], pa.binary())
        sizes = pa.array([len(v) for v in values], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, maps], ["id", "n", "bits"])


def _families(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """id, family, its tokens, for every set with an edge."""
    owners = written(components(edges, "a", "b"), "owners")
    members = signatures.select("id", "n").join(small(owners), "id")
    members = written(members.select("id", "n", F.col("root").alias("family")), "members")
    tokens = written(members.groupBy("family").agg(F.sum("n").alias("tokens")), "tokens")
    families = written(members.join(small(tokens), "family").select("id", "family", "tokens"), "families")
    discard(owners, members, tokens)
    return families


def made(sets: Callable, then: Callable | None) -> Callable:
    """For ``mapInArrow``: what ``sets`` gives, or what ``then`` makes of that, in one Python worker instead of two."""
    return (lambda batches: then(sets(batches))) if then else sets


def _closer(families: DataFrame, sets_of: Callable[..., DataFrame], num: int, den: int) -> DataFrame:
    """Edges by wide bitmaps within each family."""
    wide = written(sets_of(families.select("id"), _bitmaps, "id bigint, n bigint, bits binary"), "wide")
    blocks = F.ceil(F.col("tokens") / MEETING_TOKENS)
    met = _met(wide.join(small(families), "id"), "family", blocks, "id", F.col("n").alias("rest"), "n", "bits")
    edges = written(_by_pair_of_blocks(met).mapInArrow(freed(_edges(num, den)), LINKS), "edges")
    discard(wide)
    return edges


def _linked_blocks(sets: DataFrame, places: DataFrame, own: bool, num: int, den: int) -> DataFrame:
    """Links inside every family's blocks, or between its blocks. ``places``: id, family, blocks, component."""
    dealt = _met(places, "family", F.col("blocks"), "id", "component")
    dealt = small(written(dealt.filter("i = j" if own else "i < j"), "dealt"))
    whole = (F.length("values") / 8).cast("bigint").alias("rest")
    placed = sets.join(dealt, "id").select("key", "i", "j", "side", "id", "component", whole, "values")
    return _by_pair_of_blocks(placed).mapInArrow(freed(_linking(3, num, den)), LINKS)


def linked(
    entries: DataFrame, signatures: DataFrame, sets_of: Callable[..., DataFrame], num: int, den: int
) -> DataFrame:
    """(id, root) of every set that is linked to another, by Jaccard >= num/den.

    ``entries``: (key, id, n, rest), ids standing for different sets, ``n`` their sizes, and ``rest`` as in ``signature_tree.Sets``: of
    the keys that two linked sets share, the condition need hold for one.
    ``signatures``: (id, n, bits) with every set's size and coarse ``signature_tree.bitmap``. ``sets_of``: given a
    frame of ids, their (id, values), values being sorted distinct 64-bit hashes; given a function of Arrow batches and its
    schema too, what ``made`` gives with it. An empty table gives no rows.
    """
    shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.sum("rest").alias("tokens"))
    shared = written(shared.filter("c > 1").select("key", "tokens"), "keys")
    live = _live(entries, shared, num, den)
    edges = written(_meeting(live, signatures, num, den), "edges")
    discard(live, shared)
    families = _families(edges, signatures)
    families = _families(_closer(families, sets_of, num, den), signatures)
    sets = written(sets_of(families.select("id")), "sets")
    blocks = F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("blocks")
    places = families.select("id", "family", blocks, F.col("id").alias("component"))
    inside = written(_linked_blocks(sets, places, True, num, den), "links")
    owners = small(written(components(inside, "a", "b"), "owners"))
    split = places.filter("blocks > 1").drop("component").join(owners, "id", "left")
    split = split.select("id", "family", "blocks", F.coalesce("root", "id").alias("component"))
    across = written(_linked_blocks(sets, split, False, num, den), "links")
    discard(sets, edges)
    return components(inside.union(across), "a", "b")
