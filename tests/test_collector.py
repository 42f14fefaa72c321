"""Collector logs: lines are parsed once."""

from fanout.operators import logs


def test_pauses_by_label_parse_a_line_once(spark):
    head = "[0.1s][info][gc          ] GC(1) Pause "
    lines = [head + "Remark 1.5ms", head + "Remark 2.5ms", head + "Remark", head + "Cleanup", head + "Full (System.gc()) 9M->1K(9M) 4.0ms"]
    rows = spark.createDataFrame([("r", "c", i, x) for i, x in enumerate(lines)], "run string, container string, line_no long, line string")
    found = logs.gc_by_label(logs.gc_pauses(logs.gc_lines(rows)))
    assert sorted((r.label, r.pauses, r.total_ns) for r in found.collect()) == [
        ("Full (System.gc())", 1, 4_000_000),
        ("Remark", 2, 4_000_000),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("ms$" not in line for line in plan.splitlines() if "Filter " in line)
