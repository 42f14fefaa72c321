"""Archive rules, file sources, sinks and streaming."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fanout import schemas as S
from fanout.operators import archive, corpus, gates, transform
from fanout.session import scratch_path, scratch_root
from fanout.sources import files, sinks
from fanout.streaming import jobs

BASE = 1_704_067_200_000


def record(run_id="r1", ts=BASE, status="ok", entrant="e", variant_id="v", invocation="i1", value=1.0, **more):
    metrics = {"rows_per_s": {"value": value, "unit": "records/s", "higher_is_better": True}}
    base = {
        "schema": 2,
        "status": status,
        "run_id": run_id,
        "rep": 1,
        "reps": 3,
        "sut": {"entrant": entrant, "variant_id": variant_id, "version": "1", "image_digest": "sha256:a"},
        "run": {
            "ts_ms": ts,
            "invocation_id": invocation,
            "env_id": "env",
            "env_digest": "d",
            "harness_version": 2,
            "dataset_version": "d2",
            "trigger": "manual",
            "infra": {"digest": "x"},
        },
        "variant": {"mode": "drain", "approach": "realistic", "batches": 5},
        "metrics": metrics if status in ("ok", "infra_bound") else {},
        "note": run_id,
        "flags": [],
    }
    for path, v in more.items():
        at = base
        *parents, leaf = path.split("__")
        for p in parents:
            at = at[p]
        at[leaf] = v
    return base


def load(spark, *records):
    lines = [("f", i, json.dumps(r)) for i, r in enumerate(records)]
    return archive.kept_records(archive.parse_lines(spark.createDataFrame(lines, "path string, line_no long, line string")))


def summarise(spark, *records):
    keyed = archive.keyed(load(spark, *records))
    metrics = archive.summarise_metrics(keyed)
    return (*archive.publish(archive.summarise_rows(keyed), archive.attempts(keyed)), metrics)


def test_values_that_are_not_finite_are_a_problem(spark):
    odd = record()
    odd["metrics"] = {"rows_per_s": {"value": 1.0, "unit": "records/s", "higher_is_better": True}}
    df = load(spark, odd).withColumn(
        "metrics", F.transform_values("metrics", lambda _, m: m.withField("value", F.lit(float("inf"))))
    )
    assert "value of rows_per_s" in {r.rule for r in archive.problems(df).collect()}


def test_flags_are_told_apart_before_they_are_gathered(spark):
    many = [record(f"r{i}", flags=[f"f{i % 3}", "x"]) for i in range(30)]
    got = archive.summarise_rows(archive.keyed(load(spark, *many))).collect()
    assert [r.flags for r in got] == [["f0", "f1", "f2", "x"]]


def test_median_extremes_and_spread(spark):
    _, _, m = summarise(spark, *[record(f"r{i}", value=v) for i, v in enumerate([30.0, 10.0, 20.0, 40.0])])
    got = m.first()
    assert (got.lo, got.median, got.hi, got.n, got.spread) == (10.0, 25.0, 40.0, 4, 30.0 / 25.0)
    _, _, zero = summarise(spark, record("a", value=0.0), record("b", value=0.0))
    assert zero.first().spread is None
    _, _, one = summarise(spark, record(value=0.0))
    assert one.first().spread == 0.0


def test_tie_rules(spark):
    reps, tried, _ = summarise(
        spark,
        record("early", sut__image_digest="sha256:first"),
        record("late", sut__image_digest="sha256:second"),
        record("f1", status="failed", variant_id="w"),
        record("f2", status="unsupported", variant_id="w"),
    )
    assert reps.first().image_digest == "sha256:first"  # equal times: the earlier heads the row
    assert (tried.first().note, tried.first().status, tried.first().reps_counted) == ("f2", "unsupported", 2)


def test_worst_status_and_all_flags(spark):
    got, _, _ = summarise(
        spark,
        record("a", status="infra_bound", flags=["z"], ts=BASE - 5),
        record("b", flags=["a", "z"]),
    )
    row = archive.eligibility(got).first()
    assert (row.status, row.flags, row.unranked_because, row.plotted) == ("infra_bound", ["a", "z"], "infra-bound", False)


def test_missing_approach_is_never_ranked(spark):
    got, _, _ = summarise(spark, record(variant={"mode": "drain"}))
    assert archive.eligibility(got).first().unranked_because == "undeclared"


def test_newest_sitting_wins_even_when_it_failed(spark):
    kept, tried, _ = summarise(spark, record("old"), record("new", status="failed", ts=BASE + 1, invocation="i2"))
    assert kept.count() == 0 and tried.first().note == "new"
    kept, tried, _ = summarise(spark, record("old"), record("same", status="failed", ts=BASE + 1))
    assert kept.count() == 1 and tried.count() == 1  # a failure within the sitting evicts nothing


def test_an_unknown_status_never_becomes_a_number(spark):
    kept, tried, _ = summarise(spark, record(status="splendid", metrics={"rows_per_s": {"value": 9.0}}))
    assert kept.count() == 0 and tried.first().status == "splendid"


def test_other_configurations_are_not_mixed(spark):
    kept, _, m = summarise(spark, record("a"), record("b", variant={"mode": "drain", "approach": "realistic", "batches": 6}))
    assert kept.count() == 2 and {r.n for r in m.collect()} == {1}


def test_ranks_and_ties(spark):
    def rep(entrant, *values):
        return [record(f"{entrant}{i}", entrant=entrant, value=v) for i, v in enumerate(values)]

    kept, _, m = summarise(
        spark, *rep("a", 10.0, 12.0, 14.0), *rep("b", 13.0, 15.0, 17.0), *rep("c", 1.0, 2.0, 3.0), *[
            record("s", entrant="d", value=99.0, variant={"mode": "drain", "approach": "stripped"})
        ]
    )
    variants = spark.createDataFrame(
        [(e, "v", i, 0) for i, e in enumerate("abcd")], "entrant string, variant_id string, display_order int, variant_index int"
    )
    lanes = archive.lane_rank(archive.lanes(kept, m, variants))
    assert rows(lanes.select("entrant", "ranked", "position")) == [("a", 2, 2), ("b", 1, 1), ("c", 3, 3), ("d", None, 4)]
    tied = archive.tied_with_leader(kept, m).join(kept.select("row_key", "entrant"), "row_key")
    assert rows(tied.select("entrant", "leads", "tied")) == [("a", False, True), ("b", True, False), ("c", False, False)]


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"schema": 3}, "schema too new"),
        ({"run__invocation_id": " "}, "invocation id missing"),
        ({"run__trigger": "tuning"}, "trigger bars publication"),
        ({"flags": ["unpublishable_environment"]}, "fixture environment"),
        ({"sut__image_digest": ""}, "image digest empty"),
        ({"sut__image_digest": "latest"}, "image digest not sha256"),
        ({"sut__version": None}, "no version or commit"),
        ({"run__env_id": ""}, "env_id empty"),
        ({"run__dataset_version": None}, "dataset_version empty"),
        ({"metrics": {}}, "status without metrics"),
        ({"status": "failed"}, "metrics without status"),
        ({"rep": 0}, "rep out of range"),
        ({"rep": 4}, "rep out of range"),
        ({"metrics__rows_per_s__unit": "m/s"}, "unit of rows_per_s"),
    ],
)
def test_every_rule(spark, change, rule):
    made = record()
    metrics = made["metrics"]
    bad = record(**{k: v for k, v in change.items() if not k.startswith("metrics__")})
    if change.get("status") == "failed":
        bad["metrics"] = metrics
    if "metrics__rows_per_s__unit" in change:
        bad["metrics"]["rows_per_s"]["unit"] = "m/s"
    lines = spark.createDataFrame([(json.dumps(bad),)], "line string")
    loaded = lines.select(F.from_json("line", S.RECORD).alias("r")).select("r.*", F.lit(0).alias("pos"))
    assert [r.rule for r in archive.problems(loaded).collect()] == [rule]
    assert archive.problems(load(spark, record())).count() == 0


def test_knobs(spark):
    limits = spark.createDataFrame(
        [("e", "a", "b", None), ("e", "a", None, 3), ("e", "zz", None, 1), ("e", "a", None, None)],
        "entrant string, knob string, exceeds string, at_least long",
    )
    got = archive.knob_violations(load(spark, record(variant={"a": 2, "b": 2})), limits)
    assert rows(got.select("problem")) == [("cannot be checked",), ("misstated",), ("must be at least",), ("must exceed",)]


def test_archive_round_trip(spark):
    folder = scratch_path(spark, "archive")
    filed = archive.month_path(load(spark, record("a"), record("b", run__trigger="tuning")))
    sinks.append_archive(filed, folder)
    sinks.append_archive(filed, folder)
    back = spark.read.schema(S.RECORD).json(folder)
    assert back.count() == 4
    paths = {r[0].split(folder)[1].rsplit("/", 1)[0] for r in back.select("_metadata.file_path").distinct().collect()}
    assert paths == {f"/root={r}/env_id=env/entrant=e/month=2024-01" for r in ("results", "tuning")}


def test_archive_scan_of_files(spark, tmp_path):
    for name, lines in {"x/2024-01.jsonl": [json.dumps(record()), "", "{oops", '{"schema":1}'], "y/2024-02.jsonl": ["[]"]}.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("\n".join(lines))
    (tmp_path / "x/readme.txt").write_text("no")
    parsed = archive.parse_lines(files.archive_lines(spark, str(tmp_path)))
    assert tuple(archive.scan_counts(parsed).first()) == (2, 4, 1, 2, 1)
    assert archive.kept_records(parsed).first().variant["batches"] == "5"


def test_sampler_files(spark, tmp_path):
    counters = ",".join(S.SAMPLE_COUNTERS)
    good = ",".join(["1"] * 12)
    (tmp_path / "arm1-c1.csv").write_text(
        f"# cpu.max=6/1 memory.max=5\nt_ms,{counters}\n10,{good}\n20,{good},9\nbroken\n30,{good}\n"
    )
    name = F.regexp_extract("path", r"([^/]+)-([^/]+)\.csv", 1)
    container = F.regexp_extract("path", r"([^/]+)-([^/]+)\.csv", 2)
    got = files.sampler_series(spark, str(tmp_path), name, container)
    assert [(r.arm, r.container, r.t_ms) for r in got.orderBy("line").collect()] == [("arm1", "c1", 10), ("arm1", "c1", 30)]
    assert files.sampler_meta(spark, str(tmp_path), container).first().meta == "cpu.max=6/1 memory.max=5"


def test_query_log_refuses_error_text(spark, tmp_path):
    (tmp_path / "ok.tsv").write_text("QueryFinish\t5\t7\t{'InsertedRows':5}\n")
    assert files.query_log_tsv(spark, str(tmp_path / "ok.tsv")).first().written_rows == 5
    (tmp_path / "bad.tsv").write_text("Timeout exceeded\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.query_log_tsv(spark, str(tmp_path / "bad.tsv")).collect()


def test_ceilings_file(spark, tmp_path):
    entry = {"format": "f", "rows_per_s": 5, "client": "inside", "provenance": {"infra_digest": "x"}, "sweep": [{"concurrency": 1, "rows_per_s": 5}]}
    doc = {"consume": {"msgs_per_s": 3, "provenance": {"infra_digest": "x"}}, "ingest": [entry]}
    (tmp_path / "env1.json").write_text(json.dumps(doc, indent=1))
    consume, ingest = files.ceilings(spark, str(tmp_path))
    assert (consume.first().env, consume.first().msgs_per_s) == ("env1", 3)
    assert tuple(files.ladder(ingest).first()) == ("env1", "f", 1, 5)


def test_prefill_reuses_and_refuses(spark):
    folder = scratch_path(spark, "topic")

    def make(n):
        return lambda: spark.range(n).selectExpr("id", "cast(id % 2 as int) as partition")

    assert sinks.prefill(spark, make(6), folder, expected=6) == "written"
    assert sinks.prefill(spark, make(6), folder, expected=6) == "reused"
    with pytest.raises(ValueError, match="partial"):
        sinks.prefill(spark, make(9), folder, expected=9)


def test_truncate_leaves_an_empty_target(spark):
    folder = scratch_path(spark, "target")
    sinks.insert(transform.land(corpus.batches(corpus.batch_range(spark, 0, 2))), folder)
    sinks.truncate(spark, folder)
    assert spark.read.parquet(folder).count() == 0


def test_target_is_sorted_and_stamped_once(spark):
    folder = scratch_path(spark, "target")
    sinks.insert(transform.land(corpus.batches(corpus.batch_range(spark, 0, 30).coalesce(1))), folder)
    back = spark.read.parquet(folder)
    keys = [(r.sensor, r.batch_id, r.event_seq) for r in back.collect()]
    assert keys == sorted(keys) and back.select("ingest_ts").distinct().count() == 1


def test_replay_appends_twice_but_lands_an_epoch_once(spark):
    landed = transform.land(corpus.batches(corpus.batch_range(spark, 0, 20)))
    once, twice = scratch_path(spark, "t"), scratch_path(spark, "t")
    for _ in range(2):
        jobs.epoch_sink(once, "drain")(landed, 0)
        jobs.append_sink(twice)(landed, 0)
    assert spark.read.parquet(once).count() * 2 == spark.read.parquet(twice).count()
    verdict = gates.verdict(spark.read.parquet(twice)).first()
    assert verdict.passed and verdict.duplicates == verdict.distinct_ids


def test_two_drains_into_one_target_keep_both(spark):
    target = scratch_path(spark, "target")
    sink = jobs.epoch_sink(target)
    for lo in (0, 10):
        folder = scratch_path(spark, "nested")
        corpus.batches(corpus.batch_range(spark, lo, lo + 10)).write.parquet(folder)
        jobs.drain(jobs.start_ingest(jobs.nested_stream(spark, folder), sink, scratch_path(spark, "offsets")))
    got = gates.counts(spark.read.parquet(target)).first()
    assert (got.distinct_batches, got.duplicates) == (20, 0)
    with pytest.raises(ValueError, match="drain's name"):
        sink(spark.read.parquet(target), 0)


def test_streams_refuse_files_of_another_schema(spark):
    folder = scratch_path(spark, "nested")
    spark.range(3).write.parquet(folder)
    with pytest.raises(ValueError, match="schema mismatch"):
        jobs.nested_stream(spark, folder)


def test_a_restarted_stream_continues(spark):
    folder, target, offsets = (scratch_path(spark, n) for n in ("nested", "target", "offsets"))
    for lo in (0, 10):
        corpus.batches(corpus.batch_range(spark, lo, lo + 10)).write.mode("append").parquet(folder)
        jobs.drain(jobs.start_ingest(jobs.nested_stream(spark, folder), jobs.append_sink(target), offsets))
    assert gates.counts(spark.read.parquet(target)).first().duplicates == 0
    assert spark.read.parquet(target).select("batch_id").distinct().count() == 20


def test_live_stream_lands_and_stops(spark):
    folder, target = scratch_path(spark, "nested"), scratch_path(spark, "target")
    corpus.batches(corpus.batch_range(spark, 0, 5)).write.parquet(folder)
    query = jobs.start_ingest(jobs.nested_stream(spark, folder), jobs.epoch_sink(target), scratch_path(spark, "o"), live=True)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(target).select("batch_id").distinct().count() == 5


def test_scratch_needs_a_shared_folder_off_local():
    far = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn")
    )
    with pytest.raises(RuntimeError, match="shared folder"):
        scratch_root(far)
