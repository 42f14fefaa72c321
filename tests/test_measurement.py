"""Ordered helpers against brute force; windows, polls, resources and logs on small hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fanout import schemas as S
from fanout.operators import ceilings, logs, resources, windows
from fanout.operators.ordering import (
    lower_middle,
    nearest_rank,
    previous,
    rank_within,
    running_sum,
    select_ranks,
    upper_middle,
)


def test_select_ranks_against_sorting(spark):
    rnd = random.Random(7)
    pools = {
        "ints": [rnd.randrange(-5000, 5000) for _ in range(999)],
        "same": [3] * 500,
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-12, 15) for _ in range(400)] + [0.0] * 30,
        "one": [42],
    }
    data = [(k, float(v)) for k, vs in pools.items() for v in vs]
    df = spark.createDataFrame(data, "k string, v double")
    quantiles = {"p1": 0.001, "p50": 0.5, "p99": 0.99, "p999": 0.999}
    ranks = {n: nearest_rank(q) for n, q in quantiles.items()} | {"lo": lower_middle, "hi": upper_middle}
    got = {r.k: r for r in select_ranks(df, ["k"], "v", ranks).collect()}
    for k, vs in pools.items():
        s = sorted(map(float, vs))
        for n, q in quantiles.items():
            assert got[k][n] == s[max(1, math.ceil(round(q * 1000) * len(s) / 1000)) - 1], (k, n)
        assert (got[k].lo, got[k].hi) == (s[(len(s) - 1) // 2], s[len(s) // 2])


def test_select_ranks_of_big_longs_and_weights(spark):
    df = spark.createDataFrame([("a", 2**62, 1), ("a", 2**62 + 1, 3), ("a", -(2**62), 2)], "k string, v long, w long")
    got = select_ranks(df, ["k"], "v", {"m": nearest_rank(0.5), "x": nearest_rank(1.0)}, weight="w").first()
    assert (got.m, got.x) == (2**62, 2**62 + 1)


def test_select_ranks_of_special_doubles(spark):
    inf, nan = math.inf, math.nan
    pools = {"a": [1.0, 2.0, nan], "b": [inf, -inf, 0.0, 5.0, nan], "c": [-inf], "d": [inf, inf, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in pools.items() for v in vs], "k string, v double")
    got = {r.k: r for r in select_ranks(df, ["k"], "v", {"lo": lower_middle, "top": nearest_rank(1.0)}).collect()}
    assert got["a"].lo == 2.0 and math.isnan(got["a"].top)
    assert got["b"].lo == 5.0 and math.isnan(got["b"].top)
    assert (got["c"].lo, got["d"].lo, got["d"].top) == (-inf, inf, inf)


@pytest.mark.parametrize("q, rank", [(0.9999, 99_990), (0.00001, 1), (0.999, 99_900), (0.333333, 33_334), (1.0, 100_000)])
def test_nearest_rank_is_exact(spark, q, rank):
    assert spark.range(1).select(nearest_rank(q)(F.lit(100_000).cast("long"))).first()[0] == rank


def test_rank_within_spreads_ties(spark):
    tied = spark.range(200_000).select(F.lit("g").alias("k"), F.lit(1e9).alias("v"), F.col("id").alias("i"))
    got = rank_within(tied, ["k"], F.col("v"), [F.col("i")], "place")
    assert got.filter("place <> i + 1").count() == 0 and got.count() == 200_000


def test_rank_within_against_sorting(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.choice([-2.5, 0.0, 1e-9, 7.0, rnd.random()]), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v double, i int")
    got = {r.i: r.place for r in rank_within(df, ["k"], F.col("v"), [F.col("i")], "place").collect()}
    for key in "ab":
        want = sorted((v, i) for k, v, i in data if k == key)
        assert [got[i] for _, i in want] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_do_not_show(spark, block):
    rnd = random.Random(block)
    data = [(k, t, rnd.randrange(-9, 9)) for k in "ab" for t in rnd.sample(range(200), 40)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    sums = {(r.k, r.t): r.s for r in running_sum(df, ["k"], "t", "v", "s", block).collect()}
    prev = {(r.k, r.t): r.p for r in previous(df, ["k"], "t", "v", "p", block).collect()}
    for key in "ab":
        total, last = 0, None
        for _, t, v in sorted(d for d in data if d[0] == key):
            total += v
            assert sums[key, t] == total and prev[key, t] == last
            last = v


def polled(spark, *counts):
    return spark.createDataFrame([("r", i, c) for i, c in enumerate(counts)], "run string, tick long, rows long")


@pytest.mark.parametrize(
    "counts, at, outcome",
    [
        ([1, 5, 5, 5, 5], 4, "settled"),
        ([5, 5, 5, None, 5, 5, 5], 6, "settled"),  # an unreadable poll starts the three over
        ([5, None, 5, 5, 5], 4, "settled"),  # but is not itself a change
        ([1, 2, 3, 4], None, "not settled"),
        ([5, None, None, None, None, None, 5, 5, 5, 5], None, "unreadable"),
        ([None, None], None, "never read"),
    ],
)
def test_quiesce(spark, counts, at, outcome):
    got = windows.quiesce_point(polled(spark, *counts)).first()
    assert (got.settled_at, got.outcome) == (at, outcome)


def test_quiesce_deadline(spark):
    late = spark.createDataFrame([("r", t, t if t < 899 else 9) for t in range(0, 1000)], "run string, tick long, rows long")
    got = windows.quiesce_point(late.filter("tick < 899 or tick > 900")).first()
    assert got.outcome == "not settled" and got.rows == 898


def test_warmup(spark):
    assert windows.warmup_point(polled(spark, 0, 1, 2, 3)).first().warm_at == 3
    assert windows.warmup_point(polled(spark, 0, 1, None, 2, 3, 4, 5)).first().warm_at == 6
    assert windows.warmup_point(polled(spark, 0, 0, 0, 0)).first().outcome == "did not start"


def test_drain_complete(spark):
    def run(*counts):
        return windows.drain_complete(polled(spark, *counts).withColumn("expected_rows", F.lit(10))).first()

    assert run(1, 9, 10, 11).done_at == 2
    assert run(1, 2).outcome == "timed out"
    assert run(1, None, None, None, None, None, 10).outcome == "unreadable"


def test_backlog_window_takes_the_leanest_consumer(spark):
    depths = spark.createDataFrame([("t", p, d) for p, d in enumerate([100, 100, 30, 100])], "topic string, partition int, depth long")
    got = windows.backlog_window(depths, threads=3, msgs_per_s=40, request_s=60).first().window_s
    assert got == pytest.approx(30 / (40 * 1 / 4) * 0.7)
    empty = depths.withColumn("depth", F.lit(0).cast("long"))
    assert windows.backlog_window(empty, threads=3, msgs_per_s=40, request_s=60).first().window_s == 60


def test_load_report_recomputes_the_share(spark):
    sends = spark.createDataFrame(
        [("a", 0, 0, False, 10), ("a", 100_000, 900_000, False, 10), ("b", 0, 10, True, 1)],
        "run string, due_us long, actual_us long, failed boolean, rate long",
    )
    got = {r.run: r for r in windows.load_report(sends).collect()}
    assert got["a"].refusal == "generator too slow" and got["a"].max_lag_us == 800_000
    assert got["b"].refusal == "failed sends" and got["b"].delivered == 0


def sample(arm, container, line, t_ms, anon, **other):
    base = dict.fromkeys(S.SAMPLE_COUNTERS, 1) | {"anon": anon} | other
    return (arm, container, line, t_ms, *[base[c] for c in S.SAMPLE_COUNTERS])


SERIES = "arm string, container string, line long, t_ms long, " + ", ".join(f"{c} long" for c in S.SAMPLE_COUNTERS)


def test_container_cost_edges(spark):
    df = spark.createDataFrame(
        [
            sample("a", "x", 1, 0, 5, usage_usec=100, mem_peak=9),
            sample("a", "x", 2, 500, -1, usage_usec=900),
            sample("a", "x", 3, 1000, 7, usage_usec=400, mem_peak=8),
            sample("a", "y", 1, 0, 5),
            sample("b", "x", 1, 0, 5, usage_usec=100),
            sample("b", "x", 2, 10, 5, usage_usec=50),
        ],
        SERIES,
    )
    costs = resources.container_cost(df)
    got = {(r.arm, r.container): r for r in costs.collect()}
    x = got["a", "x"]
    assert (x.cpu_us, x.peak_anon, x.peak_charged, x.samples, x.unreadable) == (300, 7, 8, 2, 1)
    assert got["a", "y"].cpu_us is None and got["b", "x"].cpu_us == 0
    declared = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "arm string, container string")
    arms = {r.arm: r for r in resources.arm_cost(costs, declared).collect()}
    assert arms["a"].cpu_us is None and arms["b"].cpu_us == 0 and arms["c"].cpu_us is None


def brute_peak(samples):
    """Every second from the first sample to the last, each container's latest reading so far."""
    first = min(t for _, t, _ in samples)
    last = max(t for _, t, _ in samples)
    best, edge = 0, first
    while edge <= last:
        edge += 1000
        held = {}
        for c, t, v in sorted(samples, key=lambda s: s[1]):
            if t < edge:
                held[c] = v
        best = max(best, sum(held.values()))
    return best


def test_simultaneous_peak_against_brute_force(spark):
    rnd = random.Random(11)
    arms = {a: [(rnd.choice("xyz"), rnd.randrange(0, 40_000), rnd.randrange(1, 100)) for _ in range(60)] for a in "pq"}
    arms = {a: list({(c, t): (c, t, v) for c, t, v in s}.values()) for a, s in arms.items()}
    df = spark.createDataFrame([sample(a, c, t, t, v) for a, s in arms.items() for c, t, v in s], SERIES)
    got = {r.arm: r.peak_anon for r in resources.simultaneous_peak(df).collect()}
    assert got == {a: brute_peak(s) for a, s in arms.items()}


def test_peaks_that_never_coincide_are_not_added(spark):
    df = spark.createDataFrame(
        [sample("a", "x", 1, 0, 100), sample("a", "x", 2, 5000, 1), sample("a", "y", 3, 0, 1), sample("a", "y", 4, 9000, 100)],
        SERIES,
    )
    assert resources.simultaneous_peak(df).first().peak_anon == 101


def insert(kind="QueryFinish", rows_=10, **counters):
    return ("r", kind, rows_, 5, counters)


LOG = "run string, type string, written_rows long, duration_ms long, counters map<string,long>"


def test_server_cost_refusals_and_absence(spark):
    def cost(*inserts):
        return logs.server_cost(spark.createDataFrame(list(inserts), LOG), ["run"]).first()

    ok = cost(insert(UserTimeMicroseconds=7), insert("QueryStart"), insert("ExceptionWhileProcessing"), insert())
    assert (ok.cpu_us, ok.system_us, ok.queries_without_cpu, ok.refusal) == (7, 0, 1, None)
    assert ok.inserted_bytes is None and ok.failed == 1
    assert cost(insert("QueryStart")).refusal == "no attributed inserts"
    assert cost(insert(UserTimeMicroseconds=7, AsyncInsertQuery=1)).refusal == "async inserts"
    assert cost(insert(InsertedRows=7)).refusal == "no cpu counters"


@pytest.mark.parametrize(
    "text, want",
    [
        ("{}", {}),
        (" {'InsertedRows':3, 'Other':4} ", {"InsertedRows": 3}),
        ("{'InsertedRows':x}", None),
        ("{'InsertedRows':-1}", None),
        ("{InsertedRows:1}", None),
        ("Timeout exceeded", None),
    ],
)
def test_profile_events(spark, text, want):
    got = logs.parse_profile_events(spark.createDataFrame([(text,)], "profile_events string")).first()
    assert got.counters == want and got.malformed == (want is None)


G1 = """[0.011s][info][gc     ] Using G1
[0.011s][info][gc,init] Version: 25
[0.011s][info][gc,init] CPUs: 4 total
[0.011s][info][gc,init] Heap Initial Capacity: 64M
[0.011s][info][gc,init] Heap Max Capacity: 512M
[0.410s][info][gc,start    ] GC(0) Pause Young (Normal)
[0.412s][info][gc,phases   ] GC(0)   Merge Heap Roots: 0.31ms
[0.412s][info][gc,heap     ] GC(0) Old regions: 3->5
[0.413s][info][gc          ] GC(0) Pause Young (Normal) 60M->12M(512M) 2.500ms
[0.520s][info][gc          ] GC(1) Pause Full (Heap Dump) 90M->11M(128M) 2.500ms
some other program's line

[0.600s][info][safepoint   ] not ours"""


def gc(spark, text):
    lines = [("r", "c", i, line) for i, line in enumerate(text.split("\n"))]
    return logs.gc_lines(spark.createDataFrame(lines, "run string, container string, line_no long, line string"))


def test_gc_log(spark):
    got = logs.gc_summary(gc(spark, G1)).first()
    assert (got.pauses, got.total_ns, got.max_label) == (2, 5_000_000, "Full (Heap Dump)")
    assert (got.collector, got.max_bytes, got.committed_share) == ("G1", 512 * 2**20, 1.0)
    assert (got.decorated, got.gc_lines, got.foreign, got.refusal) == (11, 10, 1, None)
    assert logs.gc_summary(gc(spark, G1), (0.5, 1.0)).first().pauses == 1


def test_gc_refusals(spark):
    def refusal(text, window=None):
        return logs.gc_summary(gc(spark, text), window).first().refusal

    head = "[0.1s][info][gc] Using G1\n"
    assert refusal("hello\nworld") == "not unified logging"
    assert refusal("[0.1s][info][safepoint] x") == "no gc lines"
    assert refusal("[0.1s][info][gc] GC(9) Pause Young 1M->1M(2M) 1.0ms") == "no collector initialised"
    assert refusal(head + "[0.1s][info][gc] GC(9) Pause Young 1M->1M(2M)") == "unreadable pause"
    assert refusal(head + "[0.1s][info][gc] GC(9) Pause Young 1M->1Q(2M) 1.0ms") == "unreadable pause"
    assert refusal(head + "[0.1s][info][gc,init] Heap Max Capacity: 256") == "unreadable size"
    assert refusal("[info][gc] Using G1\n[info][gc] Pause Young 1.0ms", (0, 9)) == "no uptime"


def test_gc_generations(spark):
    text = "[0.1s][info][gc,init] Initializing The Z Garbage Collector\n[0.2s][info][gc,phases] GC(0) Y: Pause Mark Start (Major) 0.004ms"
    got = logs.gc_pauses(gc(spark, text)).first()
    assert (got.generation, got.label, got.pause_ns, got.capacity_bytes) == ("Y", "Mark Start (Major)", 4000, None)
    assert logs.gc_heap_config(gc(spark, text)).first().collector == "The Z Garbage Collector"


def test_cap_check(spark):
    readings = spark.createDataFrame(
        [("a", "# cpu.max=600000/100000 memory.max=1073741824"), ("b", "cpu.max=max/100000 memory.max=1"), ("c", "")],
        "container string, meta string",
    )
    declared = spark.createDataFrame([("a", "6", "1g"), ("b", "6", "1"), ("c", "6", "1")], "container string, cpus string, memory string")
    assert rows(resources.cap_check(readings, declared).select("container", "problem")) == [
        ("a", None),
        ("b", "cpus differ"),
        ("c", "no cpu.max"),
    ]


@pytest.mark.parametrize(
    "rates, best, seen, climbing",
    [
        ([100, 200, 300], 4, 3, True),
        ([100, 200, 205, 206, 900], 2, 4, False),  # two misses end it before the late jump
        ([100], 1, 1, True),
        ([100, 103, 106], 4, 3, True),  # exactly the margin is not an improvement
    ],
)
def test_sweep(spark, rates, best, seen, climbing):
    ladder = spark.createDataFrame([("f", 2**i, r) for i, r in enumerate(rates)], "format string, concurrency long, rows_per_s long")
    got = ceilings.sweep_plateau(ladder).first()
    assert (got.concurrency, got.rungs_seen, got.still_climbing) == (best, seen, climbing)


def test_sketches_answer_for_any_span(spark):
    """Spans cut through minutes of very unequal size; exact maxima and counts, quantiles within the promised rank."""
    base = 1_704_067_200_000
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("run"),
        F.timestamp_millis(F.lit(base) + F.pow(F.col("id") % 1000, F.lit(2)).cast("long")).alias("ingest_ts"),
        (F.col("id") * 7919 % 100_003).alias("lat"),
    ).withColumn("send_ts", F.timestamp_micros(F.unix_micros("ingest_ts") - F.col("lat")))
    sketches = windows.latency_sketches(rows, ["run"])
    first = base // windows.MINUTE_MS
    assert sketches.count() == rows.select("run", F.floor(F.unix_millis("ingest_ts") / 60_000)).distinct().count()
    for lo, hi in [(0, 20), (1, 2), (5, 16), (30, 40)]:
        found = windows.sketched_latency(sketches, ["run"], first + lo, first + hi)
        ms = base + lo * 60_000, base + hi * 60_000
        got = windows.within_rank_error(found, rows, ["run"], *ms, windows.SKETCH_RANK_ERROR).collect()
        exact = {r.run: r for r in windows.latency_exact(rows, ["run"], *ms).collect()}
        assert {r.run: (r.max_us, r.rows) for r in got} == {k: (r.max_us, r.rows) for k, r in exact.items()}
        assert all(r.p50_within and r.p99_within and r.p999_within for r in got)
