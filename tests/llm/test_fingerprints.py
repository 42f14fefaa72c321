"""Order MinHash: contract columns against Python, likeness against what it stands for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fanout.llm import order_minhash
from helpers import EDGES, documents, words


def by_id(spark, texts):
    got = order_minhash.fingerprints(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    return got


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_edges_and_order(spark):
    got = by_id(spark, EDGES)
    order = sorted(((d, t or "") for d, t in EDGES), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        e = edited(t, order[(i + 1) % len(order)][1])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = {}
    for (d, t), r in zip(order, sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        assert texts.setdefault(t, r.fingerprint) == r.fingerprint
    assert order_minhash.fingerprints(documents(spark, [])).count() == 0


def test_one_document_is_its_own_next(spark):
    (r,) = by_id(spark, [(3, "a b c d e f")])
    assert (r.near_next, r.n_chars) == (1.0, 11)
    assert r.edited_sha256 == hashlib.sha256(edited("a b c d e f", "a b c d e f").encode()).hexdigest()


@pytest.mark.parametrize("ranges", [1, 7])
def test_next_documents_across_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(order_minhash, "RANGES_PER_PARTITION", ranges)
    rnd = random.Random(1)
    texts = [(i * i, " ".join(words(rnd, rnd.randrange(30)))) for i in range(150)]
    got = {r.doc_id: r for r in by_id(spark, rnd.sample(texts, len(texts)))}
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        assert got[d].edited_sha256 == hashlib.sha256(edited(t, after).encode()).hexdigest()


def likeness(spark, a, b):
    rows = spark.createDataFrame([(1, a), (2, b)], "k long, text string").withColumn("part", F.lit(0))
    got = {r.k: r.signature for r in order_minhash.signatures(rows, ["part", "k"]).collect()}
    x, y = (F.array(*[F.lit(v) for v in got.get(k, [])]).cast("array<bigint>") for k in (1, 2))
    return spark.range(1).select(order_minhash.likeness(x, y)).first()[0]


def test_likeness_follows_edits_and_order(spark):
    rnd = random.Random(7)
    base = words(rnd, 400, 300)
    few = list(base)
    few[50] = few[51] = "changed"
    half = base[:200] + words(rnd, 200, 300)
    swapped = base[200:] + base[:200]
    scores = {n: likeness(spark, " ".join(base), " ".join(t)) for n, t in {"same": base, "few": few, "half": half, "swapped": swapped}.items()}
    assert scores["same"] == 1.0 and scores["few"] > 0.75 and scores["few"] > scores["half"] > 0.0
    # the same k-mers in another order: a set sketch would call them equal
    assert scores["swapped"] < 0.8
    assert likeness(spark, "", " \n") == 1.0 and likeness(spark, "", "a b c") == 0.0


def test_repeated_kmers_count_by_occurrence(spark):
    assert likeness(spark, "a b c " * 3, "a b c " * 40) < 0.5
    assert likeness(spark, "a b c " * 40, "a b c " * 40) == 1.0


def test_main_path_is_native(spark):
    plan = order_minhash.fingerprints(documents(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "SinglePartition"))
