"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fanout.llm import exact_dedup, jaccard_join, repeated_runs, set_links, shared, signature_tree, substring_dedup
from fanout.llm import words as hashing
from fanout.llm.components import components
from fanout.llm.shared import written
from fanout.llm.words import shingles, word_hashes
from fanout.session import scratch_root
from helpers import EDGES, documents, edited, words


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- exact ---------------------------------------------------------------------------------------


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    groups = defaultdict(list)
    for d, t in EDGES:
        groups[hashlib.sha256(lowered(t).encode()).hexdigest()].append(d)
    for r in got:
        members = groups[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(members), max(members, key=lambda d: -1 if d is None else d))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_heavy_digests_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    texts = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(600)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(documents(spark, texts)).collect()}
    sizes, last = Counter(t for _, t in texts), {t: d for d, t in texts}
    assert all((got[d].group_size, got[d].keep_id, got[d].kept) == (sizes[t], last[t], last[t] == d) for d, t in texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 6))
def test_misra_gries_error_bound(values, size):
    true, found = Counter(values), exact_dedup.summarised(values, size)
    assert len(found) <= size
    for v, n in true.items():
        assert n - len(values) / (size + 1) <= found.get(v, 0) <= n


def test_exact_stage_keeps_columns_and_one_of_repeated_rows(spark):
    docs = documents(spark, EDGES)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("text is not null and doc_id in (5, 6)").collect()) == [6]
    assert kept.count() == len({lowered(t) for _, t in EDGES})


# --- components ----------------------------------------------------------------------------------


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(99, i) for i in range(50)] + [(7, 7)],
        "random": [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.root for r in components(df, "a", "b").collect()}
    want = brute_components(links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


# --- near copies ---------------------------------------------------------------------------------


def corpus(seed, n_groups=12):
    rnd = random.Random(seed)
    texts = []
    passage = words(rnd, 60)
    for g in range(n_groups):
        base = words(rnd, rnd.choice([3, 8, 40, 120, 400]))
        for _ in range(rnd.choice([1, 2, 9])):
            texts.append(edited(rnd, base, rnd.choice([0, 0, 1, 2, max(1, len(base) // 25)])))
        if g % 3 == 0:
            texts.append(words(rnd, 30) + passage + words(rnd, 10))
    rnd.shuffle(texts)
    return [(i * 7, " ".join(t)) for i, t in enumerate(texts)]


def brute_sets(texts, width):
    out = {}
    for d, t in texts:
        w = lowered(t).encode().split()
        k = min(width, len(w))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def brute_groups(sets, num, den):
    ids = sorted(sets)
    links = [(d, d) for d in ids]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                links.append((a, b))
    return brute_components(links)


@pytest.mark.parametrize("width, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2), (1, 50, 100, 3)])
def test_jaccard_groups(spark, width, num, den, seed):
    texts = corpus(seed)
    sets = brute_sets(texts, width)
    want = brute_groups(sets, num, den)
    got = jaccard_join.jaccard_groups(documents(spark, texts), width, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(got) == len(texts)


def test_jaccard_groups_when_blocks_are_small(spark, monkeypatch):
    from fanout.llm import set_links

    monkeypatch.setattr(set_links, "MEETING_TOKENS", 200)
    monkeypatch.setattr(set_links, "BLOCK_TOKENS", 300)
    rnd = random.Random(9)
    base = words(rnd, 100)
    texts = [(i, " ".join(edited(rnd, base, i % 5))) for i in range(60)]
    want = brute_groups(brute_sets(texts, 4), 85, 100)
    got = jaccard_join.jaccard_groups(documents(spark, texts), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_edges(spark):
    got = jaccard_join.jaccard_groups(documents(spark, EDGES), 4, 85, 100).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(got) == len(EDGES) and by[5] == {(1, 5)} == by[6]
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[8] == {(1, 8)} and by[9] == {(1, 9)}
    assert jaccard_join.jaccard_groups(documents(spark, []), 4, 85, 100).count() == 0
    kept = jaccard_join.one_of_each(documents(spark, EDGES), 5, 80, 100)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 5, 7, 8, 9]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=2, max_size=70), st.integers(40, 95))
def test_tree_drops_no_pair_that_reaches(sets, num):
    values = [np.unique(np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    s = signature_tree.Sets(range(len(values)), [len(v) for v in values], [signature_tree.bitmap(v, 2) for v in values], range(len(values)))
    tree = s.tree(np.arange(len(values)))
    found = {(min(p), max(p)) for p in signature_tree.candidates(s, tree, tree, num, 100)}
    half = len(values) // 2
    both = signature_tree.candidates(s, s.tree(np.arange(half)), s.tree(np.arange(half, len(values))), num, 100)
    found_both = {(min(p), max(p)) for p in both}
    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if signature_tree.reaches(values[i], values[j], num, 100):
                assert (i, j) in found
                assert not (i < half <= j) or (i, j) in found_both


def test_rest_drops_no_pair_at_its_first_common_token():
    rnd = random.Random(11)
    values = [np.unique(np.array([rnd.randrange(40) for _ in range(30)], np.uint64)) for _ in range(50)]
    for key in range(40):
        has = [v for v in values if key in v]
        if not has:
            continue
        rest = [int((v >= key).sum()) for v in has]
        s = signature_tree.Sets(range(len(has)), [len(v) for v in has], [signature_tree.bitmap(v, 2) for v in has], range(len(has)), rest)
        tree = s.tree(np.arange(len(has)))
        found = {(min(p), max(p)) for p in signature_tree.candidates(s, tree, tree, 50, 100)}
        for i in range(len(has)):
            for j in range(i + 1, len(has)):
                first = np.intersect1d(has[i], has[j]).min() == key
                assert not (first and signature_tree.reaches(has[i], has[j], 50, 100)) or (i, j) in found


@pytest.mark.parametrize("seed", range(6))
def test_sets_leave_keys_that_link_them_to_none(seed):
    rnd = np.random.default_rng(seed)
    keys = np.sort(rnd.integers(0, 40, 150 if seed else 1))
    sizes = rnd.integers(1, 30, len(keys))
    rest = rnd.integers(1, sizes + 1)
    order = np.lexsort((sizes, keys))
    keys, sizes, rest = keys[order], sizes[order], rest[order]
    may = set_links._with_partner(keys, sizes, rest, 80, 100)
    for i in range(len(keys)):
        others = [j for j in np.flatnonzero(keys == keys[i]) if j != i]
        want = any(
            100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])
            and 180 * min(rest[i], rest[j]) >= 80 * (sizes[i] + sizes[j])
            for j in others
        )
        assert may[i] if len(others) > set_links.NEIGHBOURS else may[i] == want


def test_keys_of_the_same_sets_are_one(spark, monkeypatch):
    rows = [(1, 10, 9, 9), (1, 11, 9, 9), (2, 10, 9, 7), (2, 11, 9, 8), (3, 10, 9, 9), (3, 12, 30, 30), (4, 10, 9, 9), (4, 11, 9, 9), (4, 12, 8, 8)]
    entries = spark.createDataFrame(rows, "key long, id long, n long, rest long")
    shared = entries.groupBy("key").agg(F.sum("rest").alias("tokens"))
    got = defaultdict(set)
    for r in set_links._live(entries, shared, 80, 100).collect():
        got[r.key].add((r.id, r.rest))
    assert sorted(map(sorted, got.values())) == [[(10, 9), (11, 9)], [(10, 9), (11, 9), (12, 8)]]
    monkeypatch.setattr(set_links, "MEETING_TOKENS", 20)  # keys of several blocks keep all their sets
    got = {(r.id, r.tokens) for r in set_links._live(entries, shared, 80, 100).collect() if r.tokens > 1}
    assert got == {(10, 39), (12, 39), (10, 26), (11, 26), (12, 26)}
    assert set_links._live(entries.limit(0), shared.limit(0), 80, 100).count() == 0


def test_reaches_is_exact():
    x, y = np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)  # 90 of 110
    assert signature_tree.reaches(x, y, 90, 110) and not signature_tree.reaches(x, y, 91, 110)


# --- passages ------------------------------------------------------------------------------------


def passage_corpus(seed=4):
    rnd = random.Random(seed)
    shared = [words(rnd, 60 + 10 * i) for i in range(5)]
    texts = []
    for i in range(60):
        lines = [" ".join(words(rnd, rnd.choice([5, 30, 80]))) for _ in range(3)]
        if i % 4 == 0:
            p = shared[i // 4 % 5]
            lines.insert(rnd.randrange(4), " ".join(edited(rnd, p, i % 3)).upper() if i % 8 else " ".join(p))
        texts.append((i, "\n".join(lines)))
    return texts


def test_repeated_paragraphs(spark):
    texts = passage_corpus()
    lines = {(d, k): line for d, t in texts for k, line in enumerate(t.split("\n")) if len(line.split()) >= 50}
    ids = {p: i for i, p in enumerate(sorted(lines))}
    want = brute_groups(brute_sets([(i, lines[p]) for p, i in ids.items()], 5), 80, 100)
    sizes, back = Counter(want.values()), {i: p for p, i in ids.items()}
    got = substring_dedup.repeated_paragraphs(documents(spark, texts)).collect()
    expected = {p: back[want[i]] for p, i in ids.items() if sizes[want[i]] > 1}
    assert {(r.doc_id, r.paragraph): (r.keep_doc_id, r.keep_paragraph) for r in got} == expected
    assert all(r.removed == ((r.doc_id, r.paragraph) != (r.keep_doc_id, r.keep_paragraph)) for r in got)
    cleaned = {r.doc_id: r for r in substring_dedup.without_repeats(documents(spark, texts)).collect()}
    for d, t in texts:
        gone = {r.paragraph for r in got if r.removed and r.doc_id == d}
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert (cleaned[d].text, cleaned[d].n_chars) == (kept, len(kept))


def test_passage_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [*EDGES, (None, long), (20, long), (20, long), (21, long + "\n" + long + "\n"), (22, "\n" + long.upper())]
    docs = documents(spark, texts)
    got = substring_dedup.repeated_paragraphs(docs).collect()
    assert {(r.doc_id, r.paragraph, r.removed) for r in got} == {
        (20, 0, False), (21, 0, True), (21, 1, True), (22, 1, True)
    }
    clean = substring_dedup.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    assert {r.doc_id: r.text for r in clean.filter("doc_id in (21, 22)").collect()} == {21: "", 22: ""}
    assert clean.filter("doc_id is null").count() == 2
    assert substring_dedup.repeated_paragraphs(documents(spark, [])).count() == 0
    assert substring_dedup.without_repeats(documents(spark, [])).count() == 0


def test_bands_meet_the_recall():
    assert 1 - (1 - 0.8**3) ** substring_dedup.BANDS >= substring_dedup.RECALL
    rnd = random.Random(1)
    met = 0
    for _ in range(200):
        base = words(rnd, 120)
        pair = [substring_dedup.band_keys(np.unique(shingles(word_hashes(" ".join(t).encode()), 5))) for t in (base, edited(rnd, base, 2))]
        met += bool(set(pair[0]) & set(pair[1]))
    assert met == 200


def test_shingles_of_short_and_long_runs():
    assert len(shingles(word_hashes(b" \n"), 4)) == 0 and len(shingles(word_hashes(b"a b"), 4)) == 1
    a, b = (shingles(word_hashes(w), 4) for w in (b"a b c", b"c b a"))
    assert a[0] != b[0] and len(shingles(word_hashes(b"a " * 10), 4)) == 7


@pytest.mark.parametrize("stretch", [5, 1 << 20])
def test_words_are_hashed_alike_wherever_they_stand(monkeypatch, stretch):
    monkeypatch.setattr(hashing, "STRETCH", stretch)
    rnd = random.Random(6)
    seen = {}
    for _ in range(200):
        text = bytes(rnd.choice(b"abAB \n\t\xc3\xa9") for _ in range(rnd.randrange(80)))
        found, places = hashing.words_and_places(text)
        split = text.lower().split()
        assert len(found) == len(split)
        for word, value, at in zip(split, found.tolist(), places.tolist(), strict=True):
            assert seen.setdefault(word, value) == value and text[at : at + len(word)].lower() == word
    assert len(set(seen.values())) == len(seen)


def test_texts_hashed_together_keep_their_words_and_lines(monkeypatch):
    rnd = random.Random(8)
    texts = [bytes(rnd.choice(b"abAB \n\t\xc3\xa9") for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(300)]
    for size in (1, 60, 1 << 18):
        monkeypatch.setattr(hashing, "TOGETHER", size)
        at = 0
        for run in hashing.together(texts):
            widths = [w for w in (2, 3) if len(run.hashes) >= w]
            inside = {w: run.inside(w) for w in widths}
            for k in range(len(run.bounds) - 1):
                a, b = run.bounds[k : k + 2]
                found, places = hashing.words_and_places(texts[at + k])
                assert found.tolist() == run.hashes[a:b].tolist() and (places + run.begins[k]).tolist() == run.places[a:b].tolist()
                for w in widths:
                    assert inside[w][a:b].sum() == max(0, b - a - w + 1)
            at += len(run.bounds) - 1
        assert at == len(texts)


def test_no_operator_collects_the_table(spark):
    plan = exact_dedup.exact_groups(documents(spark, EDGES).withColumn("k", F.lit(1)))
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()


def test_families_are_summed_without_a_window(spark, monkeypatch):
    plans = []

    def kept(df, label):
        if label == "families":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(set_links, "written", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    signatures = spark.createDataFrame([(i, 10 * i) for i in (1, 2, 3, 7, 8, 9)], "id long, n long")
    got = {(r.id, r.family, r.tokens) for r in set_links._families(edges, signatures).collect()}
    assert got == {(1, 1, 60), (2, 1, 60), (3, 1, 60), (7, 7, 150), (8, 7, 150)}
    assert len(plans) == 1 and "Window" not in plans[0]


def test_whole_sets_and_their_bitmaps_take_one_python_worker(spark, monkeypatch):
    plans = []

    def kept(df, label):
        if label == "wide":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(set_links, "written", kept)
    rnd = random.Random(2)
    base = words(rnd, 200)
    texts = [(i, " ".join(edited(rnd, base, 1))) for i in range(5)] + [(9, " ".join(words(rnd, 200, 10**9)))]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(documents(spark, texts), 4, 85, 100).collect()}
    assert got == {**dict.fromkeys(range(5), 0), 9: 9}
    assert len(plans) == 1 and len(re.findall("MapInArrow", plans[0])) == 1


def test_frequent_shingles_are_tallied_from_three_documents_on():
    texts = [f"{'x y z ' * 3}{i % 4} common words here u{i}" for i in range(12)] + ["", "x", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = pa.Table.from_batches(jaccard_join._profile(3)([batch])).filter(pc.field("tally") >= 0).to_pylist()
    want = Counter(s for t in texts for s in set(shingles(word_hashes((t or "").encode()), 3).view(np.int64).tolist()))
    assert {r["token"]: r["tally"] for r in found} == {s: n for s, n in want.items() if n >= 3}


# --- runs ----------------------------------------------------------------------------------------


def test_runs_across_lines_and_inside_longer_lines(spark):
    rnd = random.Random(9)
    shared, own = words(rnd, 55), [words(rnd, 70, 10**9) for _ in range(3)]
    texts = [
        (1, " ".join(own[0] + shared)),
        (2, " ".join(own[1]) + "\n" + "\n".join(" ".join(shared[i : i + 8]).upper() for i in range(0, 55, 8)) + "\nend"),
        (3, " ".join(own[2][:40] + shared + own[2][40:])),
        (4, " ".join(shared[:49])),
    ]
    got = {r.doc_id: r.text for r in substring_dedup.without_passages(documents(spark, texts)).collect()}
    assert got == {1: texts[0][1], 2: " ".join(own[1]) + "\nend", 3: " ".join(own[2]), 4: texts[3][1]}
    found = substring_dedup.repeats(documents(spark, texts)).filter("kind = 'run'").collect()
    assert sorted((r.doc_id, r.first_word, r.n_words, r.copies, r.removed) for r in found) == [
        (1, 70, 55, 3, False), (2, 70, 55, 3, True), (3, 40, 55, 3, True)
    ]


def test_touching_repeats_are_merged_over_batches():
    rnd = random.Random(4)
    rows, want = [], []
    for doc in range(30):
        for removed in (False, True):
            spans = sorted({(f, f + 49) for f in (rnd.randrange(400) for _ in range(rnd.randrange(9)))})
            rows += [(doc, doc % 3, removed, f, last, f // 7, f, f // 5, 2) for f, last in spans]
            marked = np.zeros(500, bool)
            for f, last in spans:
                marked[f : last + 1] = True
            edges = np.flatnonzero(np.diff(np.concatenate(([0], marked, [0])))).reshape(-1, 2)
            want += [(doc, doc % 3, a, b - 1, a // 7, a, a // 5, 2, removed) for a, b in edges.tolist()]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 3, pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "version", "removed", "first", "last", "paragraph", "keep_doc_id", "keep_paragraph", "copies"]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for size in (1, 7, 10_000):
        merged = pa.Table.from_batches(repeated_runs._merged(table.to_batches(size)))
        assert list(zip(*(c.to_pylist() for c in merged.columns), strict=True)) == want


@pytest.mark.parametrize("seed", range(3))
def test_no_stretch_occurs_twice_unmarked(spark, seed):
    rnd = random.Random(seed)
    shared = [words(rnd, rnd.randrange(45, 120)) for _ in range(4)]
    texts = []
    for i in range(40):
        parts = [words(rnd, rnd.randrange(0, 60), 10**9)]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(shared)
            parts += [p[rnd.randrange(0, 20) :], words(rnd, rnd.randrange(0, 9), 10**9)]
        texts.append((i, "".join(w + rnd.choice([" ", " ", "\n"]) for p in parts for w in p)))
    texts += [(90, texts[0][1] + "x " * 130), (91, texts[5][1])]
    split = {d: t.split() for d, t in texts}
    seen, gone = {}, defaultdict(set)
    for d, t in texts:
        line = [t[: m.start()].count("\n") for m in re.finditer(r"\S+", t)]
        for w in range(len(split[d]) - 49):
            seen.setdefault(tuple(split[d][w : w + 50]), []).append((d, line[w], w))
    for places in seen.values():
        d0, _, w0 = min(places)
        for d, _, w in sorted(places)[1:]:
            gone[d].update(range(max(w, w0 + 50) if d == d0 else w, w + 50))
    marked = defaultdict(set)
    for r in substring_dedup.repeated_runs(documents(spark, texts)).filter("removed").collect():
        marked[r.doc_id].update(range(r.first_word, r.last_word + 1))
    assert marked.pop(91, set()) >= gone.pop(91, set())
    assert marked == gone
    left = {r.doc_id: r.text.split() for r in substring_dedup.without_runs(documents(spark, texts)).filter("doc_id != 91").collect()}
    assert left == {d: [w for k, w in enumerate(split[d]) if k not in gone[d]] for d in split if d != 91}


def test_python_gets_few_bytes_at_a_time(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 2000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    before = spark.conf.get(shared.BATCH_BYTES, None)
    found = [r.n for r in shared.written(docs.mapInArrow(sizes, "n bigint"), "sizes").collect()]
    assert max(found) < 1.1 * shared.BATCH and sum(found) > 29_000_000
    assert spark.conf.get(shared.BATCH_BYTES, None) == before


def test_frequent_shingles_are_tallied_across_batches():
    text = " ".join(f"w{i}" for i in range(40))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"{text} own{i}"])], ["doc_id", "text"]) for i in range(5)]
    rows = pa.Table.from_batches(list(jaccard_join._profile(5)(batches)))
    assert sorted(x for x in rows.column("tally").to_pylist() if x) == [5] * 36
    assert rows.num_rows == 5 + 36


def test_a_written_table_leaves_no_shuffle_files(spark):
    def left() -> int:
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))

    before, told = left(), spark.conf.get(shared.CLEANUP, None)
    rows = spark.range(20_000).groupBy((F.col("id") % 9000).alias("a")).agg(F.max("id").alias("b"))
    shared.written(rows.join(rows.withColumnRenamed("b", "c"), "a"), "links")
    shared.small(shared.written(rows, "links"))
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before
    assert spark.conf.get(shared.CLEANUP, None) == told


def test_what_a_step_wrote_goes_when_its_result_is_kept(spark):
    folder = Path(scratch_root(spark).removeprefix("file:"))
    docs = documents(spark, [(i, " ".join(f"w{k}" for k in range(i % 5, i % 5 + 40))) for i in range(30)])
    there = {p.name for p in folder.glob("*")} if folder.exists() else set()
    kept = jaccard_join.one_of_each(docs, 5, 80, 100).count()
    substring_dedup.without_passages(docs).count()
    made = {p.name.split("-")[0] for p in folder.glob("*") if p.name not in there}
    assert kept < 30 and made <= {"lost", "gone"}
