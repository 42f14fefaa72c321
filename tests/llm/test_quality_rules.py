"""Line rules against a plain reading of their definition, and on edges."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fanout.llm import quality_rules
from fanout.llm.quality_rules import MEASURES, PHRASES, SEPARATORS, Rules, repeated_words
from helpers import EDGES, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """All measures and the verdict, character by character."""
    text = text or ""
    words, rules = WORD.findall(text), Rules()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, doubled, failed, lost = set(), 0, Counter(), 0
    for line in text.split("\n"):
        ws = WORD.findall(line)
        if not ws:
            continue
        doubled += line in seen
        seen.add(line)
        apart = sum(w in SEPARATORS for w in ws)
        low = "".join(c.lower() if c.isascii() else c for c in line)
        ends = [w for w in ws if re.search(r"[.!?…。！？][\"'”’»)\]]*$", w)]
        marks = [w for w in ws if re.search(r"[!?#*$%&|<>]{2,}$", w)]
        if apart >= 2 and 100 * apart >= 20 * len(ws):
            rule = 1
        elif len(ws) <= 40 and any(p in low for p in PHRASES):
            rule = 2
        elif not ends or 100 * len(marks) > 30 * len(ws):
            rule = 3
        else:
            continue
        failed[rule] += 1
        lost += sum(map(len, ws))
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    base = len(words) < rules.least_words or 100 * len(covered) > 20 * len(words)
    counts = (len(words), chars, symbols, doubled, len(covered), failed[1], failed[2], failed[3], lost)
    return (*counts, base, not (base or 100 * lost > 30 * chars))


def made(rnd):
    """A text of lines that pass, lines that fail each rule, and repeats of both."""
    lines = []
    for _ in range(rnd.randrange(12)):
        ws = [rnd.choice(["Éa", "the", "dog", "runs", "wide", "日本", "über"]) for _ in range(rnd.randrange(1, 14))]
        kind = rnd.randrange(7)
        if kind < 3:
            lines.append(" ".join(ws) + rnd.choice([".", "?", "!”", "…", "。", '.")']))
        elif kind == 3:
            lines.append(rnd.choice([" | ", " » ", " · "]).join(ws))
        elif kind == 4:
            lines.append(" ".join(ws) + " " + rnd.choice(PHRASES).title() + ".")
        elif kind == 5:
            lines.append(" ".join(w + rnd.choice(["!!", "###", "&&&", "."]) for w in ws))
        else:
            lines.append(rnd.choice(lines) if lines else "\t \x0b")
    return rnd.choice(["\n", "\n\n", "\r\n"]).join(lines)


def test_every_measure_by_brute_force(spark):
    rnd = random.Random(13)
    texts = [(i, made(rnd)) for i in range(300)] + [(1000 + i, t) for i, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.verdicts(documents(spark, texts)).collect()}
    assert got == {d: brute(t) for d, t in texts}
    assert {r[-1] for r in got.values()} == {True, False}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6))
def test_repeated_words(ids, width):
    import numpy as np

    windows = Counter(tuple(ids[i : i + width]) for i in range(len(ids) - width + 1))
    want = {i + k for i in range(len(ids) - width + 1) if windows[tuple(ids[i : i + width])] > 1 for k in range(width)}
    assert repeated_words(np.array(ids, np.int64), width) == len(want)


GOOD = "The dog runs over the hill and does not come back. It was late, and rain had begun to fall again."
MORE = "Nobody had seen it since noon, so we went home without a word."
LAST = "In the morning a boy brought news from the mill, where two millers had found tracks in fresh mud."


@pytest.mark.parametrize(
    "line, measure",
    [
        ("Home | News | Sport | Weather", "n_navigation_lines"),
        ("Start » Shop » Shoes", "n_navigation_lines"),
        ("© 2020 Example. All Rights Reserved.", "n_boilerplate_lines"),
        ("This work is licensed under the GNU General Public License, version 3.", "n_boilerplate_lines"),
        ("Share on every network", "n_punctuation_lines"),
        ("BUY!! NOW!! OR!! NEVER!!", "n_punctuation_lines"),
    ],
)
def test_each_rule(spark, line, measure):
    docs = documents(spark, [(1, f"{GOOD}\n{line}\n{MORE} {LAST}")])
    row = quality_rules.verdicts(docs).first()
    assert row[measure] == 1 and sum(row[m] for m in MEASURES[5:8]) == 1 and row.kept
    out = quality_rules.cleaned(docs).first()
    assert out.text == f"{GOOD}\n{MORE} {LAST}" and out.n_chars == len(out.text)


def test_long_lines_may_speak_of_cookies_and_ends_may_be_missing(spark):
    text = f"{GOOD} {MORE} {LAST} The cookie policy says who may eat them. mail@example.org 10.0.0.1"
    row = quality_rules.verdicts(documents(spark, [(1, text)])).first()
    assert row.kept and row.lost_chars == 0


def test_lines_go_first_then_documents(spark):
    nav = "\n".join(f"Page{i} | News{i} | Sport{i}" for i in range(30))
    docs = documents(spark, [(1, f"{GOOD}\n{nav}"), (2, GOOD), (3, None)])
    assert [r.kept for r in quality_rules.verdicts(docs).orderBy("doc_id").collect()] == [False, True, False]
    assert [r.doc_id for r in quality_rules.cleaned(docs).collect()] == [2]


def test_edges_keep_rows_columns_and_types(spark):
    docs = documents(spark, EDGES)
    assert quality_rules.verdicts(docs).count() == len(EDGES)
    out = quality_rules.cleaned(docs.unionByName(documents(spark, [(None, GOOD), (None, GOOD)])))
    assert out.schema == docs.schema and [(r.doc_id, r.text) for r in out.collect()] == [(None, GOOD)] * 2
    empty = documents(spark, [])
    assert quality_rules.verdicts(empty).collect() == [] and quality_rules.cleaned(empty).collect() == []


def test_clean_documents_stay_and_junk_goes(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.verdicts(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    share = dict(map(tuple, rows.collect()))
    assert share[1] > 0.9 and share[0] < 0.1
