"""The interval join against a nested loop, its plan, and the queries built on it."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fanout.operators import intervals, logs, windows
from fanout.operators.intervals import in_windows

POINTS, WINDOWS = "id long, run string, t long", "name string, run string, a long, z long"


def made(rnd, n_points, n_windows, hot=False):
    points = [(i, f"r{rnd.randrange(3)}", 500 if hot and i % 2 else rnd.randrange(-2000, 60_000)) for i in range(n_points)]
    spans = []
    for i in range(n_windows):
        a = rnd.randrange(-2500, 60_000)
        spans.append((f"w{i}", f"r{rnd.randrange(3)}", a, a + rnd.choice([0, 1, 2, 3, 4, 5, 17, 64, 700, 4096, 50_000, -5])))
    return points, spans


def pairs(points, spans, keyed):
    return Counter((p[0], w[0]) for p in points for w in spans if w[2] <= p[2] < w[3] and (not keyed or p[1] == w[1]))


def joined(spark, points, spans, keyed, **hot):
    p, w = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, WINDOWS)
    if not keyed:
        w = w.drop("run")
    return in_windows(p, F.col("t"), w, "a", "z", ["run"] if keyed else [], **hot)


@pytest.mark.parametrize("keyed", [False, True])
def test_against_a_nested_loop(spark, keyed):
    points, spans = made(random.Random(3), 800, 120)
    got = joined(spark, points, spans, keyed)
    assert Counter(map(tuple, got.select("id", "name").collect())) == pairs(points, spans, keyed)
    assert got.columns == (["run", "id", "t", "name", "a", "z"] if keyed else ["id", "run", "t", "name", "a", "z"])


def test_hot_bins_are_split_and_lose_nothing(spark):
    points, spans = made(random.Random(4), 900, 60, hot=True)
    got = joined(spark, points, spans, False, hot_points=20)
    assert Counter(map(tuple, got.select("id", "name").collect())) == pairs(points, spans, False)


def test_a_hot_bin_spreads_over_tasks(spark):
    points = [(i, "r", 500) for i in range(4000)]
    got = joined(spark, points, [("w", "r", 0, 1000)], False, hot_points=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and got.count() == 4000
    keys = [f.dataType for f in got.schema]
    assert len(keys) == 6


@pytest.mark.parametrize("points, spans", [([], [("w", "r", 0, 9)]), ([(1, "r", 3)], []), ([(1, "r", None)], [("w", None, None, 4)])])
def test_empty_and_null(spark, points, spans):
    assert joined(spark, points, spans, False).collect() == []


def test_no_cross_join(spark):
    points, spans = made(random.Random(5), 50, 20)
    plan = joined(spark, points, spans, False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_very_long_and_very_short_windows_use_few_bins(spark):
    spans = [("a", "r", 0, 1), ("b", "r", 0, 1 << 62), ("c", "r", -(1 << 61), 5), ("d", "r", 7, 7 + (1 << 40))]
    points = [(0, "r", 0), (1, "r", 1), (2, "r", 1 << 40), (3, "r", -1), (4, "r", (1 << 62) - 1), (5, "r", 1 << 62)]
    got = joined(spark, points, spans, False)
    assert Counter(map(tuple, got.select("id", "name").collect())) == pairs(points, spans, False)


def moment(us):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)


def test_runs_have_their_own_windows(spark):
    base = 1_704_067_200_000
    rnd = random.Random(6)
    landed = [(rnd.randrange(4_000_000), rnd.randrange(900)) for _ in range(500)]
    frame = spark.createDataFrame([(moment(a), moment(a + d)) for a, d in landed], "send_ts timestamp, ingest_ts timestamp")
    spans = [("all", 0, 10_000), ("half", 0, 2_000), ("one", 1500, 1501), ("none", 9_000, 9_500), ("over", 1000, 3000)]
    table = spark.createDataFrame([(r, base + a, base + z) for r, a, z in spans], "run string, from_ms long, to_ms long")
    counts = {r.run: r.rows for r in windows.rows_by_run(frame, table).collect()}
    quantiles = {r.run: r for r in windows.latency_by_run(frame, table).collect()}
    for run, a, z in spans:
        inside = sorted(d for at, d in landed if a <= (at + d) // 1000 < z)
        assert counts[run] == len(inside) == quantiles[run].rows
        assert quantiles[run].refusal == (None if inside else "no rows in window")
        if inside:
            assert quantiles[run].p50_us == inside[(len(inside) + 1) // 2 - 1] and quantiles[run].max_us == inside[-1]


def test_only_the_days_of_the_windows_are_read(spark, tmp_path):
    """A file of any other day is spoiled: reading it would fail the query."""
    days = [dt.datetime(2024, 1, d, 12) for d in range(1, 21)]
    rows = [(i, d.date(), d, "Insert", True, ["t"], {"UserTimeMicroseconds": 1}) for i, d in enumerate(days)]
    schema = (
        "id long, event_date date, query_start_time timestamp, query_kind string, is_initial_query boolean, "
        "tables array<string>, profile_events map<string, bigint>"
    )
    folder = str(tmp_path / "log")
    spark.createDataFrame(rows, schema).repartition(1).write.partitionBy("event_date").parquet(folder)
    log = spark.read.parquet(folder)
    for day in (1, 8, 20):
        for file in (tmp_path / "log" / f"event_date=2024-01-{day:02d}").glob("*.parquet"):
            file.write_bytes(b"spoiled" * 100)
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    at = int(dt.datetime(2024, 1, 5, tzinfo=dt.UTC).timestamp() * 1000)
    table = spark.createDataFrame([("a", at, at + 86_400_000), ("b", at + 8 * 86_400_000, at + 10 * 86_400_000)], "run string, from_ms long, to_ms long")
    table.write.parquet(str(tmp_path / "windows"))
    got = logs.attribute_to_runs(log, spark.read.parquet(str(tmp_path / "windows")), ["t"])
    assert sorted((r.run, r.id) for r in got.collect()) == [("a", 4), ("b", 12), ("b", 13)]


def test_levels(spark):
    lengths = [1, 2, 3, 4, 5, 15, 16, 63, 64, 65, 1 << 40, (1 << 62) - 1]
    frame = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", intervals._level(F.col("n")).alias("k"))
    assert all(4**r.k <= r.n < 4 ** (r.k + 1) for r in frame.collect())


def test_window_sums_against_a_nested_loop(spark):
    points, spans = made(random.Random(8), 400, 60, hot=True)
    spans.append(("w3", "r1", 0, 30_000))  # a second window of one owner
    p, w = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, WINDOWS)
    got = intervals.window_sums(p, F.col("t"), {"n": F.lit(1), "ids": F.col("id")}, w, "a", "z", ["name"], ["run"])
    n, ids = Counter(), Counter()
    for name, run, a, z in spans:
        for i, r, t in points:
            if r == run and a <= t < z:
                n[name, run] += 1
                ids[name, run] += i
    assert {(r["name"], r["run"]): (r["n"], r["ids"]) for r in got.collect() if r["n"]} == {k: (n[k], ids[k]) for k in n}


def test_sums_over_windows_copy_no_row_for_a_window(spark):
    """Forty windows over the same four rows: no operator may hold a row for each pair."""
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (1, 2, 3, 4)]
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1000)
    spans = spark.createDataFrame([(f"w{i}", base, base + 1000 * i) for i in range(40)], "run string, from_ms long, to_ms long")
    log = spark.createDataFrame(
        [("QueryFinish", "Insert", t, 5 if i else None, {"NetworkReceiveElapsedMicroseconds": i}) for i, t in enumerate(at)],
        "type string, query_kind string, event_time timestamp, duration_ms long, profile_events map<string, bigint>",
    )
    want = logs.network_totals(logs.logged_in_windows(log, spans), ["run"])
    got = logs.run_network_totals(log, spans)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
