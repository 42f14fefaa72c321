"""Consuming by offsets across stops and failures; inserts with tokens across replays, crashes and races."""

from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fanout.sources import tokens
from fanout.sources.tokens import TokenTable
from fanout.sources.topic import TopicReader, consume
from fanout.streaming import jobs


def messages(spark, lo, hi, partitions=3):
    n = F.col("id")
    return spark.range(lo, hi).select(
        n.cast("string").alias("key"),
        n.cast("string").cast("binary").alias("value"),
        F.lit("t").alias("topic"),
        (n % partitions).cast("int").alias("partition"),
        F.call_function("div", n, F.lit(partitions)).alias("offset"),
    )


def produce(spark, folder, lo, hi):
    messages(spark, lo, hi).repartition(2).write.mode("append").partitionBy("partition").parquet(folder)


@pytest.fixture
def topic(spark, tmp_path):
    folder = str(tmp_path / "topic")
    produce(spark, folder, 0, 300)
    return folder


def landed(spark, out):
    return Counter((r.partition, r.offset, r.key) for r in spark.read.parquet(out).collect())


def wanted(spark, lo, hi):
    return Counter((r.partition, r.offset, r.key) for r in messages(spark, lo, hi).collect())


def runs_until_dry(spark, topic, tmp_path, limit=70, sink=None, group=True):
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    sink = sink or jobs.folder_sink(out)
    group = str(tmp_path / "group") if group else None
    return out, jobs.drain_by_restarts(
        lambda: jobs.start_sink(consume(spark, topic, group, limit), sink, offsets)
    )


def test_restarts_land_every_message_once(spark, topic, tmp_path):
    out, runs = runs_until_dry(spark, topic, tmp_path)
    assert runs >= 4 and landed(spark, out) == wanted(spark, 0, 300)
    produce(spark, topic, 300, 350)
    out, runs = runs_until_dry(spark, topic, tmp_path)
    assert runs == 1 and landed(spark, out) == wanted(spark, 0, 350)


def test_without_a_limit_one_run_takes_all(spark, topic, tmp_path):
    out, runs = runs_until_dry(spark, topic, tmp_path, limit=None, group=False)
    assert runs == 1 and landed(spark, out) == wanted(spark, 0, 300)


def test_a_failed_batch_is_consumed_again(spark, topic, tmp_path):
    out, calls = str(tmp_path / "out"), []
    inner = jobs.folder_sink(out)

    def failing(rows, epoch):
        inner(rows, epoch)
        calls.append(epoch)
        if calls == [0, 1]:
            raise RuntimeError("lost after the write")

    with pytest.raises(StreamingQueryException):
        runs_until_dry(spark, topic, tmp_path, sink=failing)
    out, _ = runs_until_dry(spark, topic, tmp_path, sink=failing)
    assert calls[:3] == [0, 1, 1] and landed(spark, out) == wanted(spark, 0, 300)


def test_latest_skips_what_is_there(spark, topic, tmp_path):
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    start = lambda: jobs.start_sink(consume(spark, topic, latest=True), jobs.folder_sink(out), offsets)
    assert jobs.drain_by_restarts(start) == 0
    produce(spark, topic, 300, 330)
    assert jobs.drain_by_restarts(start) == 1
    assert landed(spark, out) == wanted(spark, 300, 330)


def test_slices_name_only_files_that_hold_their_offsets(spark, topic):
    produce(spark, topic, 300, 600)
    reader = TopicReader({"path": topic})
    assert reader.latestOffset() == {"0": 200, "1": 200, "2": 200}
    whole = reader.partitions({}, {"0": 200, "1": 200, "2": 200})
    late = reader.partitions({"0": 150, "1": 200}, {"0": 160, "1": 200, "2": 5})
    assert [(s.partition, s.start, s.end) for s in late] == [(0, 150, 160), (2, 0, 5)]
    assert all(0 < len(s.files) < len(w.files) for s, w in zip(late, [whole[0], whole[2]], strict=True))
    assert sum(b.num_rows for b in reader.read(late[0])) == 10


def test_limits_and_empty_topics(tmp_path):
    with pytest.raises(ValueError, match="group"):
        TopicReader({"path": "x", "pertrigger": "5"})
    reader = TopicReader({"path": str(tmp_path / "none")})
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []


# --- tokens --------------------------------------------------------------------------------------


def rows(spark, n):
    return spark.range(1).select(F.lit(n).alias("n"))


def held(table):
    frame = table.read()
    return sorted(r.n for r in frame.collect()) if frame is not None else []


def test_replays_inside_and_outside_the_window(spark, tmp_path):
    table = TokenTable(spark, str(tmp_path / "t"), window=3)
    assert held(table) == []
    assert [table.insert(rows(spark, n), f"t{n}") for n in (1, 2, 3, 1, 4, 3, 1)] == [True, True, True, False, True, False, True]
    assert held(table) == [1, 1, 2, 3, 4]
    assert table.state().tokens == ("t3", "t4", "t1")


def test_rows_without_a_commit_are_not_seen(spark, tmp_path):
    table = TokenTable(spark, str(tmp_path / "t"))
    table.insert(rows(spark, 1), "a")
    lost = table.write(rows(spark, 2))
    assert held(table) == [1] and held(TokenTable(spark, str(tmp_path / "t"))) == [1]
    assert table.insert(rows(spark, 2), "b") and held(table) == [1, 2]
    assert (tmp_path / "t" / lost).exists()


def test_two_writers_race(spark, tmp_path, monkeypatch):
    one, two = TokenTable(spark, str(tmp_path / "t")), TokenTable(spark, str(tmp_path / "t"))
    one.insert(rows(spark, 0), "z")
    stale, again = one.write(rows(spark, 1)), one.write(rows(spark, 2))
    before = one.state()
    assert two.insert(rows(spark, 5), "a")
    states = iter([before])
    real = TokenTable.state
    monkeypatch.setattr(TokenTable, "state", lambda self: next(states, None) or real(self))
    assert one.commit(stale, "b")  # its place was taken: it goes after
    states = iter([before])
    assert not one.commit(again, "a")  # the other's token by now
    monkeypatch.undo()
    assert held(two) == [0, 1, 5] and one.state().tokens == ("z", "a", "b") and one.state().version == 3
    assert not (tmp_path / "t" / again).exists()


def test_snapshots_sum_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SNAPSHOT", 3)
    table = TokenTable(spark, str(tmp_path / "t"), window=2)
    for n in range(8):
        assert table.insert(rows(spark, n), f"t{n}")
    names = sorted(p.name for p in (tmp_path / "t" / "log").glob("*.json") if not p.name.startswith("."))
    assert sum(n.endswith(".all.json") for n in names) == 2
    for n in names:  # entries before the last snapshot are not needed
        if n.endswith(".one.json") and int(n[:20]) < 6:
            (tmp_path / "t" / "log" / n).unlink()
    assert held(table) == list(range(8)) and table.state().version == 8 and table.state().tokens == ("t6", "t7")


def test_a_stream_replayed_from_an_old_checkpoint_lands_once(spark, topic, tmp_path):
    table = TokenTable(spark, str(tmp_path / "t"))

    def sink(frame, epoch):
        for _ in range(2):
            table.insert(frame, f"drain/{epoch}")

    runs_until_dry(spark, topic, tmp_path, sink=sink)
    assert Counter(r.key for r in table.read().collect()) == Counter(str(n) for n in range(300))
