"""Settling, warm-up and the end of a drain, told while the polls come in.

A run's polls are a stream (run, tick, rows[, expected_rows]), ``rows`` null where the count could not be read. Each run
has a state that outlives micro-batches and restarts: how far its rule has come, a few numbers whatever the number of
polls. Every micro-batch tells the state of the runs it polled; once ``decided``, nothing to come changes it.

Ticks of a run come in order. A tick is complete when a later one has come, so its polls may be spread over
micro-batches; the newest tick counts provisionally. A poll of an older tick comes too late: it is counted and has no say.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fanout import schemas as S

# workers get these functions by value: they need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STABLE_POLLS = 3
Step = Callable[[dict, int, int | None, int | None], None]


def _unreadable(state: dict, tick: int, rows: int | None, limit: int) -> None:
    state["unread"] = state.get("unread", 0) + 1 if rows is None else 0
    if state["unread"] >= limit and "gave_up_at" not in state:
        state["gave_up_at"] = tick


def _gave_up_first(state: dict, at: str) -> bool:
    return "gave_up_at" in state and (at not in state or state["gave_up_at"] < state[at])


class Quiesce:
    """Three polls running that repeat the last readable count; one that cannot be read starts the three over."""

    columns = "settled_at bigint, rows bigint, outcome string"

    def __init__(self, deadline: int = S.QUIESCE_MAX_S, failures: int = S.PROBE_MAX_FAILURES):
        self.deadline, self.failures = deadline, failures

    def step(self, state: dict, tick: int, rows: int | None, expected: int | None) -> None:
        _unreadable(state, tick, rows, self.failures)
        same = rows is not None and rows == state.get("last")
        state["streak"] = state.get("streak", 0) + 1 if same else 0
        if state["streak"] >= STABLE_POLLS and "settled_at" not in state:
            state["settled_at"], state["settled_rows"] = tick, rows
        if rows is not None:
            state["last"] = rows

    def told(self, state: dict) -> tuple:
        if _gave_up_first(state, "settled_at"):
            return None, None, "unreadable"
        if "last" not in state:
            return None, None, "never read"
        if "settled_at" not in state:
            return None, state["last"], "not settled"
        return state["settled_at"], state["settled_rows"], "settled"

    def decided(self, state: dict) -> bool:
        return "settled_at" in state or "gave_up_at" in state


class WarmUp:
    """Three increases running between adjacent readable polls."""

    columns = "warm_at bigint, outcome string"

    def __init__(self, deadline: int = S.WARMUP_MAX_S):
        self.deadline = deadline

    def step(self, state: dict, tick: int, rows: int | None, expected: int | None) -> None:
        before = state.get("before")
        rose = rows is not None and before is not None and rows > before
        state["streak"] = state.get("streak", 0) + 1 if rose else 0
        if state["streak"] >= STABLE_POLLS and "warm_at" not in state:
            state["warm_at"] = tick
        state["before"] = rows

    def told(self, state: dict) -> tuple:
        return (state["warm_at"], "warm") if "warm_at" in state else (None, "did not start")

    def decided(self, state: dict) -> bool:
        return "warm_at" in state


class Drained:
    """The first poll at or past the expected count, unless probing failed before."""

    columns = "done_at bigint, outcome string"

    def __init__(self, deadline: int = S.DRAIN_MAX_S, failures: int = S.PROBE_MAX_FAILURES):
        self.deadline, self.failures = deadline, failures

    def step(self, state: dict, tick: int, rows: int | None, expected: int | None) -> None:
        _unreadable(state, tick, rows, self.failures)
        if rows is not None and expected is not None and rows >= expected and "done_at" not in state:
            state["done_at"] = tick

    def told(self, state: dict) -> tuple:
        if _gave_up_first(state, "done_at"):
            return None, "unreadable"
        return (state["done_at"], "drained") if "done_at" in state else (None, "timed out")

    def decided(self, state: dict) -> bool:
        return "done_at" in state or "gave_up_at" in state


Rule = Quiesce | WarmUp | Drained


def advance(rule: Rule, held: dict, polls: list[tuple[int, int | None, int | None]]) -> dict:
    """The state after some more polls (tick, rows, expected) of a run, ascending by tick."""
    for tick, rows, expected in polls:
        pending = held.get("pending")
        if pending and tick < pending[0]:
            held["late"] = held.get("late", 0) + 1
            continue
        if pending and tick == pending[0]:
            for place, new in ((1, rows), (2, expected)):
                if new is not None and (pending[place] is None or new > pending[place]):
                    pending[place] = new
            continue
        if pending:
            _complete(rule, held, pending)
        held.setdefault("opened", tick)
        held["pending"] = [tick, rows, expected]
    return held


def _complete(rule: Rule, held: dict, pending: list) -> None:
    tick, rows, expected = pending
    if tick - held["opened"] > rule.deadline:
        held["beyond"] = held.get("beyond", 0) + 1
    else:
        rule.step(held.setdefault("rule", {}), tick, rows, expected)


def report(rule: Rule, held: dict) -> tuple:
    """(the rule's columns, polls_beyond, late_polls, decided), the newest tick counting as if it were complete."""
    view = json.loads(json.dumps(held))
    sure = rule.decided(view.get("rule", {})) or view.get("beyond", 0) > 0
    _complete(rule, view, view["pending"])
    return *rule.told(view.get("rule", {})), view.get("beyond", 0), view.get("late", 0), sure or view.get("beyond", 0) > 0


def told_live(polls: DataFrame, rule: Rule) -> DataFrame:
    """A stream of (run, the rule's columns, polls_beyond, late_polls, decided): one row a run and micro-batch that polled it."""
    expected = F.col("expected_rows") if "expected_rows" in polls.columns else F.lit(None).cast("long")
    narrow = polls.select("run", F.col("tick").cast("long"), F.col("rows").cast("long"), expected.alias("expected"))
    schema = f"run string, {rule.columns}, polls_beyond bigint, late_polls bigint, decided boolean"
    names = [part.split()[0] for part in schema.split(", ")]

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        polled = []
        for part in parts:
            whole = part[["tick", "rows", "expected"]].astype("Int64").astype(object)
            polled += [tuple(None if pd.isna(v) else int(v) for v in row) for row in whole.itertuples(index=False)]
        polled.sort(key=lambda p: p[0])
        held = advance(rule, held, polled)
        state.update((json.dumps(held),))
        row = (key[0], *report(rule, held))
        yield pd.DataFrame({n: pd.Series([v], dtype=object) for n, v in zip(names, row, strict=True)})

    return narrow.groupBy("run").applyInPandasWithState(update, schema, "held string", "update", GroupStateTimeout.NoTimeout)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The last that was told of each run, from a folder that ``jobs.folder_sink`` filled."""
    told = spark.read.parquet(path)
    columns = [c for c in told.columns if c not in ("run", "drain", "epoch")]
    best = told.groupBy("run").agg(F.max_by(F.struct(*columns), F.col("epoch").cast("long")).alias("best"))
    return best.select("run", "best.*")


def all_decided(spark: SparkSession, path: str) -> bool:
    """Whether every run told of so far is decided: the time to stop polling."""
    return newest(spark, path).filter("not decided").isEmpty()
