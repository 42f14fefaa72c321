"""Corpus, transform, gates: golden values, edge rows, and one corruption per gate."""

import json
import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from fanout import schemas as S
from fanout.functions import corpus as C
from fanout.functions import wire
from fanout.functions.text import ascii_upper, string_fingerprint
from fanout.operators import checksums, corpus, expectation, gates, transform
from fanout.operators.transform import land_flat
from fanout.plans import inputs
from fanout.session import scratch_path
from fanout.sources.messages import batch_avro_schema, split_broken

# Published sums of the first thousand batches.
GOLDEN = {
    "rows": 73500,
    "value_sum": 36712213045500,
    "value_scaled_sum": 1903970758089327,
    "sensor_sum": 862547254290276801415122,
    "region_sum": 789224923606139885762498,
    "name_sum": 650904861039966432802372,
    "unit_sum": 635040811622225011500,
    "tag_count_sum": 105000,
    "tag_sum": 483030864161340461867712,
    "batch_ts_sum": 130242000036711750,
    "null_quality_rows": 17500,
}
FINGERPRINTS = {
    "": 0,
    "ms": 57568,
    "METRIC_7": 9557931003773166724,
    "metric_7": 11872851856941630628,
    "sensor-1023": 11861606880014931878,
    "region-3": 11930833490185392805,
    "tag-15tag-0tag-1": 14456948040575913637,
}


@pytest.fixture(scope="module")
def landed(spark):
    return transform.land(corpus.batches(corpus.batch_range(spark, 0, 60))).cache()


def test_expected_range_is_golden(spark):
    got = expectation.expected_range(spark, 0, 1000).first().asDict()
    assert {k: int(got[k]) for k in GOLDEN} == GOLDEN


def test_transform_reaches_the_same_sums(spark):
    landed = transform.land(corpus.batches(corpus.batch_range(spark, 0, 1000)))
    got = gates.sums(landed).first().asDict()
    assert {k: int(v) for k, v in got.items()} == {k: v for k, v in GOLDEN.items() if k != "rows"}
    assert landed.count() == GOLDEN["rows"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(s,) for s in FINGERPRINTS], "s string").select("s", string_fingerprint(F.col("s")))
    assert {s: int(v) for s, v in df.collect()} == FINGERPRINTS


def test_fingerprint_is_unsigned_beyond_ascii(spark):
    s = "ÿ" * 8
    raw = s.encode()
    want = int.from_bytes(raw[:8], "little") + int.from_bytes(raw[::-1][:8], "little")
    assert spark.range(1).select(string_fingerprint(F.lit(s))).first()[0] == Decimal(want)


def test_range_is_a_difference_of_prefixes(spark):
    direct = expectation.expected_range(spark, 17, 93).drop("lo", "hi").first()
    assert [int(v) for v in expectation.prefix_difference(spark, 17, 93).first()] == [int(v) for v in direct]
    assert expectation.expected_rows(spark, 17, 93).first()[0] == direct.rows


def test_three_spellings_land_the_same(spark):
    batches = corpus.batches(corpus.batch_range(spark, 0, 50))
    a = transform.land(batches)
    assert a.columns == S.COLUMNS
    assert rows(a) == rows(transform.land_by_array(batches)) == rows(transform.land_sql(batches))
    assert rows(a) == rows(transform.land_flat(corpus.flat_messages(corpus.batch_range(spark, 0, 50))))


def event(seq, name="n", unit="ms", value=10, quality=None, tags=()):
    return (seq, name, unit, value, quality, list(tags))


def test_edge_rows(spark):
    batch = (
        5,
        "s",
        None,
        1,
        2,
        [
            event(0, quality=0.2),
            event(1, quality=0.19),
            event(2, unit="drop"),
            event(3, name="ıßa", value=-7),
            event(4, tags=["x"]),
        ],
    )
    df = spark.createDataFrame([batch, (6, "s", "r", 1, 2, [])], S.BATCH)
    got = {r.event_seq: r for r in transform.land(df).collect()}
    assert set(got) == {0, 3, 4}
    assert got[3].name_upper == "ıßA" and got[3].region == "" and got[3].quality is None
    assert got[3].value_scaled == -1750 and got[4].tags == ["x"]
    seven = spark.createDataFrame([(1, "s", None, 1, 2, [event(1, value=-7)])], S.BATCH)
    assert transform.land(seven).first().value_scaled == -3500


def test_truncation_is_toward_zero(spark):
    df = spark.createDataFrame([(-7, 1)], "v long, s int").select(transform.scaled(F.col("v"), F.col("s") + 15))
    assert df.first()[0] == -411  # -7000 / 17 = -411.76


def test_out_of_range_ids_fail(spark):
    bad = spark.createDataFrame([(-1, "s", None, 1, 2, [event(0)])], S.BATCH)
    with pytest.raises(PySparkException, match="negative batch_id"):
        transform.land(bad).collect()


def test_schema_is_checked(spark):
    S.require_schema(spark.createDataFrame([], S.BATCH), S.BATCH)
    with pytest.raises(ValueError, match="schema mismatch"):
        S.require_schema(spark.range(1), S.BATCH)


@pytest.mark.parametrize("b", [0, 7, 2**32 - 1, 2**32, 18_446_688_737_413, 10**14, 9_000_000_000_000_000, 2**63 - 1])
def test_values_wrap_at_64_bits(spark, b):
    got = spark.range(1).select(corpus.C.value(F.lit(b).cast("long"), F.lit(99))).first()[0]
    assert got == (b * 1_000_003 + 99 * 97) % 2**64 % 2147483647


def test_a_correct_table_passes_and_replays_only_count(landed):
    ok = gates.verdict(landed).first()
    assert ok.passed and ok.duplicates == 0 and (ok.lo, ok.hi) == (1, 59)
    replayed = gates.verdict(landed.union(landed.filter("batch_id between 20 and 22"))).first()
    assert replayed.passed and replayed.duplicates > 0


def test_partial_boundary_batches_pass(landed):
    cut = landed.filter("not (batch_id in (0, 59) and event_seq > 4)")
    assert gates.verdict(cut).first().passed


CORRUPTIONS = {
    "contiguous": lambda df: df.filter("batch_id <> 30"),
    "value_match": lambda df: df.withColumn("value", F.col("value") + 1),
    "value_scaled_match": lambda df: df.withColumn("value_scaled", F.col("value") * 1000),
    "sensor_match": lambda df: df.withColumn("sensor", F.lit("s")),
    "region_match": lambda df: df.withColumn("region", F.when(F.col("region") != "", F.col("region"))),
    "name_match": lambda df: df.withColumn("name_upper", F.lower("name_upper")),
    "unit_match": lambda df: df.withColumn("unit", F.lit("")),
    "tag_count_match": lambda df: df.withColumn("tags", F.array(F.concat_ws("", "tags"))),
    "tag_match": lambda df: df.withColumn("tags", F.transform("tags", lambda t: F.upper(t))),
    "batch_ts_match": lambda df: df.withColumn(
        "batch_ts", F.timestamp_millis(F.expr("unix_millis(batch_ts) div 1000"))
    ),
    "null_quality_match": lambda df: df.withColumn("quality", F.coalesce("quality", F.lit(0.5))),
    "send_after_base": lambda df: df.withColumn("send_ts", F.timestamp_micros(F.lit(1))),
}


@pytest.mark.parametrize("gate", CORRUPTIONS)
def test_each_corruption_fails_its_gate(landed, gate):
    got = gates.verdict(CORRUPTIONS[gate](landed)).first()
    failed = {c for c in gates.CHECKS if not got[c]}
    assert gate in failed and not got.passed and gates.REASONS[gate] in got.reasons
    if gate not in ("contiguous", "region_match"):
        assert failed == {gate}


def test_too_narrow_tables_are_refused(landed):
    for df in (landed.filter("batch_id < 0"), landed.filter("batch_id = 3"), landed.filter("batch_id in (3, 4)")):
        with pytest.raises(ValueError, match="too narrow"):
            gates.verdict(df)


def test_window_is_the_whole_table_but_its_ends(landed):
    w = gates.gate_window(landed)
    assert (w.lo, w.hi) == (1, 59)


def test_a_fault_far_below_the_newest_batch_fails(spark):
    ids = spark.range(100_010).withColumnRenamed("id", "batch_id")
    rows = transform.land_flat(corpus.flat_messages(ids, 4)).filter("event_seq < 4")
    low = gates.observe(rows, gates.Window(0, 100_009, 1, 100_009)).first()
    worse = rows.withColumn("value", F.when(F.col("batch_id") == 5, 0).otherwise(F.col("value")))
    seen = gates.observe(worse, gates.gate_window(worse)).first()
    assert (seen.lo, seen.hi) == (1, 100_009) and seen.distinct_batches == low.distinct_batches
    assert seen.value_sum != low.value_sum and seen.unit_sum == low.unit_sum


def test_gate_has_one_fact_exchange_and_no_fan_out(spark, landed):
    folder = scratch_path(spark, "landed")
    landed.write.parquet(folder)
    plan = gates.sums(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "event_seq" in line]
    assert len(wide) == 1


def test_conflicting_copies_count_as_rows_of_their_own(landed):
    twice = landed.union(landed.filter("batch_id = 20").withColumn("value", F.col("value") + 1))
    got = gates.verdict(twice).first()
    assert not got.value_match and got.distinct_ids == gates.verdict(landed).first().distinct_ids


def test_verify_finds_only_what_was_changed(spark):
    batches = corpus.batches(corpus.batch_range(spark, 0, 20))
    assert gates.verify(batches).count() == 0
    odd = batches.withColumn("region", F.when(F.col("batch_id") == 3, F.lit("x")).otherwise(F.col("region")))
    assert [(r.batch_id, r.seq, r.wrong) for r in gates.verify(odd).collect()] == [(3, None, ["region"])]


def test_frames(spark):
    df = spark.createDataFrame([(7, b"abc"), (300, b"")], "id long, d binary").select(
        wire.build_frame(F.col("id"), F.col("d")).alias("value")
    )
    assert [bytes(r.value) for r in df.collect()] == [b"\x00\x00\x00\x00\x07abc", b"\x00\x00\x00\x01\x2c"]
    good, bad = split_broken(df, 7)
    assert good.count() == 1 and bad.first().problem == "too short"


def test_avro_schema_has_two_unions():
    s = json.loads(batch_avro_schema())
    unions = [f["name"] for f in s["fields"] if isinstance(f["type"], list)]
    inner = s["fields"][-1]["type"]["items"]["fields"]
    assert unions == ["region"] and [f["name"] for f in inner if isinstance(f["type"], list)] == ["quality"]


def test_ascii_upper_leaves_other_scripts(spark):
    assert spark.range(1).select(ascii_upper(F.lit("aıßÿZ9"))).first()[0] == "AıßÿZ9"


def test_verify_reads_no_array_beside_its_events(spark):
    batches = corpus.batches(spark.range(20).withColumnRenamed("id", "batch_id"))
    plan = gates.verify(batches)._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate explode(events" in line]
    assert generates and all("[0]" in g or "[1]" in g for g in generates)


def test_row_difference_counts_both_ways(spark):
    rnd = random.Random(9)
    make = lambda n: [(rnd.randrange(4), rnd.choice([None, 1, 2]), rnd.choice(["a", None, ""])) for _ in range(n)]
    want, have = make(60), make(70)
    schema = "k long, n long, s string"
    got = gates.row_difference(spark.createDataFrame(want, schema), spark.createDataFrame(have, schema), ["k"])
    w, h = Counter(want), Counter(have)
    expected = Counter()
    for row in w.keys() | h.keys():
        if w[row] != h[row]:
            kind = "lost" if not h[row] else "extra" if not w[row] else "repeated" if h[row] > w[row] else "short"
            expected[(row[0], kind, abs(w[row] - h[row]))] += 1
    assert Counter(map(tuple, got.collect())) == expected and len(expected) > 5


def test_row_difference_of_equal_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a")], "k long, s string")
    assert gates.row_difference(rows, rows, ["k"]).collect() == []
    assert gates.row_difference(rows.limit(0), rows.limit(0), ["k"]).collect() == []
    assert [tuple(r) for r in gates.row_difference(rows, rows.limit(0), ["k"]).collect()] == [(1, "lost", 2)]


def test_sums_of_replayed_and_conflicting_rows(spark):
    """Copies count once, rows of one id that differ count each, whatever batch they are in."""
    rows = land_flat(corpus.flat_messages(spark.range(40).withColumnRenamed("id", "batch_id")))
    clean = gates.sums(rows).first()
    replayed = rows.unionByName(rows.filter("batch_id % 5 = 1")).unionByName(rows.filter("batch_id = 3"))
    assert gates.sums(replayed).first() == clean
    other = rows.filter("batch_id = 2 and event_seq = 1").withColumn("value", F.col("value") + 7)
    assert other.count() == 1
    more = gates.sums(replayed.unionByName(other)).first()
    assert more.value_sum == clean.value_sum + other.first().value and more.sensor_sum > clean.sensor_sum


def test_no_row_meets_the_replayed_batches_by_a_shuffle(spark, landed):
    """Rows are joined with marks of bounded size, broadcast; only the rows of marked batches go anywhere."""
    folder = scratch_path(spark, "landed")
    landed.unionByName(landed.filter("batch_id % 3 = 0")).write.parquet(folder)
    plan = gates.sums(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_row_difference_compares_rows_of_unlike_keys_only(spark):
    rows = spark.range(3000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    odd = rows.filter("v <> 7").unionByName(spark.createDataFrame([(None, 1), (5, 5)], "k long, v long"))
    got = gates.row_difference(rows, odd, ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == [(5, "repeated", 1), (7, "lost", 1), (None, "extra", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_the_landed_corpus_is_not_stored(spark, data):
    for made in (inputs.landed_corpus, inputs.broken_corpus, inputs.altered_corpus):
        assert not made(spark, data).inputFiles() or all("staged" not in f for f in made(spark, data).inputFiles())


def test_filter_yield_builds_no_array_of_events(spark, data):
    from fanout.plans import ingest

    got = ingest.filter_yield(spark, data)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first() == transform.survival(corpus.batches(inputs.event_ids(spark, data))).first()


def test_events_from_cycles_are_the_events(spark):
    ids = [0, 1, 7, 96, 97, 1000, 123_456_789, (1 << 42) - 1, 1 << 42, (1 << 42) + 5]
    df = spark.createDataFrame([(i,) for i in ids], "b long")
    got = {r.b: r.e for r in df.select("b", C.events(F.col("b"), 130).alias("e")).collect()}
    for b in ids:
        for s, e in enumerate(got[b]):
            value = (b * 1_000_003 + s * 97) % 2**64 % S.VALUE_MODULUS
            quality = None if (b + s) % 5 == 0 else (b * 13 + s * 7) % 100 / 100.0
            tags = [f"tag-{(b + s + j) % S.TAGS}" for j in range((b + s) % 4)]
            assert tuple(e) == (s, f"metric_{(b * 31 + s) % S.NAMES}", S.UNITS[(b * 7 + s) % 8], value, quality, tags)
    plan = df.filter("b < 1000").select(C.events(F.col("b")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "arrays_zip" in plan


def test_text_sums_of_a_table_are_those_of_its_rows(spark):
    words = ["", "a", "é", "\x00", "\x00b", "seven77", "eight888", "nine99999", "ÿ€😀ÿ€😀", "x" * 300, None, "ß\x7f\x80"]
    rows = [(i - 3, w, words[-1 - i]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "n long, a string, b string")

    def own(w):
        raw = (w or "").encode()
        return int.from_bytes(raw[:8].ljust(8, b"\0"), "little") + int.from_bytes(raw[::-1][:8].ljust(8, b"\0"), "little")

    got = checksums.checksum(df, {"n": F.col("n")}, {"a": F.col("a"), "b": F.col("b")}).first()
    assert [int(x) for x in got] == [sum(r[0] for r in rows), sum(own(r[1]) for r in rows), sum(own(r[2]) for r in rows)]
    assert [int(x) for x in checksums.checksum(df.limit(0), {"n": F.col("n")}, {"a": F.col("a")}).first()] == [0, 0]
    assert [int(x) for x in checksums.checksum(df, {"n": F.col("n")}).first()] == [sum(r[0] for r in rows)]


def test_no_method_of_the_sums_is_too_large_to_be_compiled(spark, data, capsys):
    rows = inputs.broken_corpus(spark, data)
    marks = spark.createDataFrame([], "_word long, _marks long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        gates.sums(gates.in_window(rows, gates.Window(0, 90, 1, 90)), marks).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # bytes of code, beyond which the JVM interprets a method
