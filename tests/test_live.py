"""Rules told live against the batch operators over the same polls, however the polls are cut up."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fanout.operators import windows
from fanout.streaming import jobs, live

POLLS = "run string, tick long, rows long, expected_rows long"
RULES = {
    "quiesce": (live.Quiesce, windows.quiesce_point),
    "warmup": (live.WarmUp, windows.warmup_point),
    "drain": (live.Drained, windows.drain_complete),
}


def made(rnd, runs=14):
    """Runs that settle, never settle, cannot be read, start late, go past the deadline; some ticks polled twice."""
    out = []
    for r in range(runs):
        rows, tick = 0, rnd.randrange(50)
        for _ in range(rnd.choice([1, 3, 8, 30, 60])):
            tick += rnd.choice([1, 1, 1, 2]) if r % 5 else rnd.choice([1, 400])
            rows += rnd.choice([0, 0, 0, 5]) if r % 2 else rnd.choice([0, 3, 4])
            for _ in range(rnd.choice([1, 1, 2])):
                out.append((f"r{r}", tick, None if rnd.random() < (0.75 if r % 7 == 3 else 0.1) else rows, 20))
    return out


@pytest.mark.parametrize("name", sorted(RULES))
def test_equals_the_batch_rule_across_a_restart(spark, tmp_path, name):
    rule, batch = RULES[name]
    polls = made(random.Random(name))
    frame = spark.createDataFrame(polls, POLLS)
    folder, out, offsets = (str(tmp_path / n) for n in ("polls", "out", "offsets"))
    cuts = [0, 9, 60, 75, 200, 1000, 10**9]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        # parts overlap: the newest tick of one comes again in the next
        frame.filter(f"tick >= {a} and tick <= {z}").coalesce(1).write.mode("append").parquet(folder)
        if k in (2, len(cuts) - 2):
            stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(folder)
            jobs.drain(jobs.start_sink(live.told_live(stream, rule()), jobs.folder_sink(out), offsets, mode="update"))
    got = {r.run: r for r in live.newest(spark, out).collect()}
    want = {r.run: r.asDict() for r in batch(frame).collect()}
    assert {k: {c: r[c] for c in want[k]} for k, r in got.items()} == want
    assert all(r.late_polls == 0 for r in got.values())
    assert len({r.outcome for r in got.values()}) > 1
    assert live.all_decided(spark, out) == all(r.decided for r in got.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_cuts_do_not_matter(rows, cuts):
    polls = [(10 + k // 2, r, 3) for k, r in enumerate(rows)]
    for rule in (live.Quiesce(9), live.WarmUp(9), live.Drained(9)):
        whole = live.report(rule, live.advance(rule, {}, polls))
        held, at = {}, 0
        for cut in [*sorted(c for c in cuts if c < len(polls)), len(polls)]:
            held, at = live.advance(rule, held, polls[at:cut]), cut
        assert live.report(rule, held) == whole


def test_decided_stays_decided():
    rule = live.Quiesce(100)
    held = live.advance(rule, {}, [(t, 5, None) for t in range(6)])
    before = live.report(rule, held)
    assert before[:3] == (3, 5, "settled") and before[-1]
    after = live.report(rule, live.advance(rule, held, [(t, t, None) for t in range(6, 40)]))
    assert after[:3] == before[:3] and after[-1]


def test_late_polls_have_no_say():
    rule = live.WarmUp(100)
    held = live.advance(rule, {}, [(5, 1, None), (6, 2, None)])
    held = live.advance(rule, held, [(4, 99, None), (7, 3, None)])
    assert live.report(rule, held) == (None, "did not start", 0, 1, False)
