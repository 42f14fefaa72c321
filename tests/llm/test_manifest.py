"""The Merkle manifest against trees built one by one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fanout.llm import manifest, queries
from helpers import EDGES, documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and for every leaf its siblings as (before, after), level by level."""
    above, paths, places = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(above) > 1:
        runs = [above[i : i + 3] for i in range(0, len(above), 3)]
        for path, place in zip(paths, places, strict=True):
            run, slot = runs[place // 3], place % 3
            path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        places = [p // 3 for p in places]
        above = [h(*run) for run in runs]
    return above[0], paths


def first(v):
    return (v is not None, v)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((first(r["doc_id"]), leaf([r[f] for f in FIELDS]), r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([d for _, d, _ in sorted(groups[s])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for (_, digest, doc_id), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            yield doc_id, digest, trees[s][0], root, tuple(path + top)


def found(docs):
    rows = manifest.manifest(docs, FIELDS, "source", "doc_id").collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in rows)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 0, 9, 10], [81, 82, 1], [250, 27, 28, *[1] * 90]])
def test_trees_of_many_sizes(spark, sizes):
    rnd = random.Random(len(sizes))
    rows = [(rnd.randrange(10**6), f"t{rnd.random()}", "en", f"s{k}", 9) for k, n in enumerate(sizes) for _ in range(n)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == Counter(brute([r.asDict() for r in docs.collect()]))


def test_edges_nulls_repeats_and_clashing_columns(spark):
    nulls = [(None, None, None, None, None), (None, None, None, None, None), (5, "é\n", "de", None, 2), (5, "a", None, "", 1)]
    docs = documents(spark, EDGES)
    more = spark.createDataFrame(nulls, "doc_id long, text string, lang string, source string, n_chars long")
    for c in [*docs.columns[5:], "tree", "place", "node", "path", "root"]:
        docs, more = (d.withColumn(c, F.lit("clash")) for d in (docs, more))
    both = docs.unionByName(more)
    assert found(both) == Counter(brute([r.asDict() for r in both.collect()]))
    assert found(documents(spark, [])) == Counter()


def test_query_finds_the_tampered(spark, data):
    rows = [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in rows}
    got = {r.doc_id: r for r in queries.op12_merkle_manifest(spark, data).collect()}
    want = list(brute(rows))
    assert len(got) == len(want)
    for doc_id, digest, subroot, root, path in want:
        r = got[doc_id]
        assert (r.leaf, r.subroot, r.root) == (digest, subroot, root)
        assert r.proof_sha256 == h(*[x for p in path for x in p])
        torn = zlib.crc32(str(doc_id).encode()) % 2 == 0 and "\n" in texts[doc_id]
        assert r.verified == (not torn) == (r.folded_root == root)
    assert {r.verified for r in got.values()} == {True, False}


def test_every_changed_byte_changes_the_fold(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(40)])
    kept = {"other": manifest.leaf([F.col(f) if f != "text" else F.concat("text", F.lit(" ")) for f in FIELDS])}
    rows = manifest.manifest(docs, FIELDS, "source", "doc_id", kept)
    assert manifest.verified(rows, F.col("leaf")).filter("not verified").isEmpty()
    assert manifest.verified(rows, F.col("other")).filter("verified").isEmpty()


def test_one_exchange_serves_a_block(spark):
    nodes = spark.range(1000).select(
        (F.col("id") % 3).alias("tree"), F.col("id").alias("place"), F.struct(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("item")).alias("node")
    )
    plan = manifest._pivots(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
