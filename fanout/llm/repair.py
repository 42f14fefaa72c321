"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``.

Rows of a conversation are kept (K), given another role (R), deleted (D), or have an empty message put between them
(I). A state says what the output ends in; every edit leads from a node (rows consumed, state) to one other node. Least costs
to the end come from a dynamic program; the arcs on them are the optimal ones. Which to follow is settled by path
ranking: nodes are ranked by the least audit of 1, 2, 4, ... edits that optimal arcs spell from them, each rank pairing
a node's with that of the node its doubled pointer leads to. Of a node's optimal arcs the one with the least letter, then
the least rank behind it, is taken, and the pointers, doubled, give every position of the audit at once.

However long a conversation is, no task holds it. Rows are dealt by ranges of the whole order, and a conversation's
rows in one run of 2 ** PIECE_BITS places are a piece, kept as one letter a row. Pieces are solved alone; those of a
conversation that has several pass four costs backward and one state forward, read in order while nothing
but these is held. Only ``digests``, a hash over all text of a conversation, reads that text in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout.llm.shared import cells, importable, written

PIECE_BITS = 12
SAMPLED = 32  # characters of a text that ranges are dealt by
AT_ONCE = 1 << 15  # rows whose paths are ranked together
GAP = 8  # places between rows of a conversation, for messages put in

SPACES = " \t\n\x0b\x0c\r"

# what the output so far ends in: nothing, a system turn, a user's turn, an assistant's
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
ACCEPTED = [0, NEVER, NEVER, 0]
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = "DIKR"  # in ASCII order

# A row's letter: its role's initial, s, u, a or another (o); upper case where the row must go, a digit where it is truncated.
# After a piece's rows: a full stop where the conversation ends, else a comma.
LAST, MORE = ".", ","
CODES = {
    letter: (place, must_go, extra)
    for place in range(4)
    for letter, must_go, extra in (("suao"[place], False, 0), ("SUAO"[place], True, 0), ("0123"[place], False, TRUNCATED))
}
SPOKEN = [USER, USER, ASSISTANT, USER]  # the turn after a state, by rerole or insert


def kept_state(initial: int, state: int) -> int:
    """The state after a row of this role is kept, -1 where it may not stand."""
    if initial == 0:
        return SYSTEM if state == START else -1
    if initial == 1:
        return -1 if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else -1


KEPT = [[kept_state(i, s) for s in range(4)] for i in range(4)]
LEGAL = {(0, 1), (1, 2), (2, 1)}

_KEPT, _SPOKEN = np.array(KEPT), np.array(SPOKEN)
_INITIAL, _MUST_GO, _EXTRA, _END, _LAST = (np.zeros(128, np.int64) for _ in range(5))
for _letter, _facts in CODES.items():
    _INITIAL[ord(_letter)], _MUST_GO[ord(_letter)], _EXTRA[ord(_letter)] = _facts
_END[[ord(LAST), ord(MORE)]] = _LAST[ord(LAST)] = 1


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs when messages may be put in here: a user's turn after any but a user's, an assistant's after that."""
    start, system, user, assistant = costs
    user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return [min(start, user + INSERT), min(system, user + INSERT), user, assistant]


def costs_to_end(codes: str, end: list[int], last: bool) -> list[list[int]]:
    """Least cost from every state before every row, and after all rows, to the end of the conversation.

    ``end`` are the costs beyond the piece, with messages put in there unless the piece is the last.
    """
    after = _with_inserts(end) if last else end
    table = [after]
    for code in reversed(codes):
        initial, must_go, extra = CODES[code]
        costs = [c + DELETE for c in after]
        if not must_go:
            for state in range(4):
                least = after[SPOKEN[state]] + REROLE
                to = KEPT[initial][state]
                if to >= 0 and after[to] < least:
                    least = after[to]
                if least + extra < costs[state]:
                    costs[state] = least + extra
        after = _with_inserts(costs)
        table.append(after)
    table.reverse()
    return table


def audit_cost(codes: str, audit: str) -> int:
    cost, row = 0, 0
    for letter in audit:
        cost += INSERT if letter == "I" else DELETE if letter == "D" else REROLE if letter == "R" else 0
        if letter != "I":
            cost += CODES[codes[row]][2] if letter != "D" else 0
            row += 1
    return cost


class Paths(NamedTuple):
    """Least audits from all nodes of some pieces, 4 nodes a row and 4 at a piece's end."""

    letter: np.ndarray  # 1 to 4, 0 where a piece ends
    length: np.ndarray
    jumps: list[np.ndarray]  # the node 1, 2, 4, ... edits on

    def ends(self, nodes: np.ndarray) -> np.ndarray:
        """State that the audits from these nodes end in."""
        return self.jumps[-1][nodes] % 4

    def audits(self, nodes: np.ndarray) -> list[str]:
        length = self.length[nodes]
        stops = np.cumsum(length)
        place = np.arange(int(length.sum())) - np.repeat(stops - length, length)
        at = np.repeat(nodes, length)
        for k, jump in enumerate(self.jumps):
            moved = (place >> k & 1).astype(bool)
            at[moved] = jump[at[moved]]
        text = "".join(LETTERS[x - 1] for x in self.letter[at].tolist())
        return [text[b - n : b] for b, n in zip(stops.tolist(), length.tolist(), strict=True)]


def least_paths(codes: str, costs: np.ndarray) -> Paths:
    """Paths over pieces' codes, each with its end mark, from the costs before every row and at every end."""
    code = np.frombuffer(codes.encode(), np.uint8)
    ends = _END[code].astype(bool)[:, None]
    place = np.arange(len(code))[:, None]
    here, below = 4 * place, 4 * (place + 1)
    free = ~ends & (_MUST_GO[code] == 0)[:, None]
    extra, kept = _EXTRA[code][:, None], _KEPT[_INITIAL[code]]
    inserting = ~ends | _LAST[code].astype(bool)[:, None]
    shape = (len(code), 4)
    arcs = [  # allowed, target, price, in the letters' order
        (~ends, below + np.arange(4), DELETE),
        (inserting, here + _SPOKEN, INSERT),
        (free & (kept >= 0), below + kept, extra),
        (free, below + _SPOKEN, extra + REROLE),
    ]
    least = costs.reshape(-1)
    targets = np.empty((4 * len(code), 4), np.int64)
    optimal = np.empty((4 * len(code), 4), bool)
    for k, (allowed, target, price) in enumerate(arcs):
        allowed = np.broadcast_to(allowed, shape).ravel()
        target = np.where(allowed, np.broadcast_to(target, shape).ravel(), 0)
        price = np.broadcast_to(price, shape).ravel()
        targets[:, k] = target
        optimal[:, k] = allowed & (least < NEVER) & (price + least[target] == least)
    nodes, leaving = np.arange(len(targets)), optimal.any(axis=1)

    # ranks by the least audits of 1, 2, 4, ... edits, each from the ranks at both ends of a pointer
    first = optimal.argmax(axis=1)
    rank = np.where(leaving, first + 1, 0)
    ahead = np.where(leaving, targets[nodes, first], nodes)
    while True:
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
        further = ahead[ahead]
        if np.array_equal(further, ahead):
            break
        ahead = further

    # of optimal arcs the least letter, then the least rank of the node behind it
    order = np.arange(4) * (int(rank.max()) + 1) + rank[targets]
    chosen = np.where(optimal, order, np.iinfo(np.int64).max).argmin(axis=1)
    length, jumps = leaving.astype(np.int64), [np.where(leaving, targets[nodes, chosen], nodes)]
    while True:
        jump = jumps[-1]
        further = length + length[jump]
        if np.array_equal(further, length):
            return Paths(np.where(leaving, chosen + 1, 0), length, jumps)
        length = further
        jumps.append(jump[jump])


# --- passes over pieces: rows (conv, piece, start, codes, ...) ---------------------------------------

Rows = Iterator[dict]


def _over(df: DataFrame, work: Callable[[Rows], Rows], added: str) -> DataFrame:
    """The rows of a table of pieces, those that ``work`` yields, with some columns more; a task holds a few at a time."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {added}"
    names = [*df.columns, *(part.split()[0] for part in added.split(", "))]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    kinds_of = [f.dataType.simpleString() for f in df.schema] + [part.split()[1] for part in added.split(", ")]
    types = [kinds[k] for k in kinds_of]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Rows:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    yield from batch.slice(at, 64).to_pylist()

        for held in _groups(work(read())):
            columns = [pa.array([r[n] for r in held], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _groups(rows: Rows) -> Iterator[list[dict]]:
    """Pieces by turns, so many together that their rows are AT_ONCE or a few more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["codes"]) + 1
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _crossings(rows: Rows) -> Rows:
    """Costs from each state before a piece to each one after it, for those that are not the last."""
    units = [[0 if t == s else NEVER for s in range(4)] for t in range(4)]
    for row in rows:
        yield row | {"crossing": [c for unit in units for c in costs_to_end(row["codes"], unit, False)[0]]}


def _beyond(rows: Rows) -> Rows:
    """From a conversation's last piece to its first: the costs beyond each."""
    for _, pieces in groupby(rows, itemgetter("conv")):
        last, costs = True, ACCEPTED
        for row in pieces:
            yield row | {"last": last, "beyond": costs}
            crossing = row["crossing"]
            if last:
                costs, last = costs_to_end(row["codes"], ACCEPTED, True)[0], False
            else:
                costs = [min(NEVER, *(crossing[4 * t + s] + costs[t] for t in range(4))) for s in range(4)]


def _solved(rows: Rows) -> Iterator[tuple[list[dict], np.ndarray, Paths]]:
    """Groups of pieces, the node before each piece's first row in state START, and their paths."""
    for held in _groups(rows):
        costs = [c for r in held for c in costs_to_end(r["codes"], r["beyond"], r["last"])]
        sizes = np.array([len(r["codes"]) + 1 for r in held])
        codes = "".join(r["codes"] + (LAST if r["last"] else MORE) for r in held)
        yield held, 4 * (np.cumsum(sizes) - sizes), least_paths(codes, np.array(costs, np.int64))


def _turned(rows: Rows) -> Rows:
    """The state after a piece, from each state before it."""
    for held, nodes, paths in _solved(rows):
        turned = paths.ends(nodes[:, None] + np.arange(4)).tolist()
        for row, states in zip(held, turned, strict=True):
            yield row | {"turned": states}


def _before(rows: Rows) -> Rows:
    """From a conversation's first piece to its last: the state before each, and whether it begins against the order."""
    for _, pieces in groupby(rows, itemgetter("conv")):
        state, code = START, None
        for row in pieces:
            broken = code is not None and (CODES[code][0], CODES[row["codes"][0]][0]) not in LEGAL
            yield row | {"before": state, "broken": int(broken)}
            state, code = row["turned"][state], row["codes"][-1]


def _audited(rows: Rows) -> Rows:
    for held, nodes, paths in _solved(rows):
        audits = paths.audits(nodes + np.array([r["before"] for r in held]))
        for row, audit in zip(held, audits, strict=True):
            places = [CODES[c][0] for c in row["codes"]]
            broken = row["broken"] + sum(pair not in LEGAL for pair in zip(places, places[1:], strict=False))
            yield row | {"audit": audit, "cost": audit_cost(row["codes"], audit), "illegal": broken}


# --- messages and digests ------------------------------------------------------------------------


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of pieces whose audit comes before their rows, each piece in order."""
    names = ["conv", "place", "role", "text", "edit"]
    letters, state, conv, at = iter(()), START, None, 0

    def put_in(letter: str, out: list[list], place: int) -> None:
        nonlocal state
        state = SPOKEN[state]
        out.append([conv, place, "user" if state == USER else "assistant", b"", letter])

    def messages(batch: pa.RecordBatch, out: list[list]) -> None:
        nonlocal letters, state, conv, at
        narrow = [batch.column(n).to_pylist() for n in ("conv", "place", "role", "audit", "before")]
        for *row, text in zip(*narrow, cells(batch.column("text")), strict=True):
            key, place, role, audit, before = row
            if audit is not None:
                rest(out)
                letters, state, conv, at = iter(audit), before, key, place
                continue
            at = place
            for k in range(GAP):
                letter = next(letters)
                if letter == "I":
                    put_in("I", out, place + k - 3)
                    continue
                if letter == "R":
                    state = SPOKEN[state]
                    role = "user" if state == USER else "assistant"
                elif letter == "K":
                    state = KEPT["sua".index(role[0])][state]
                if letter != "D":
                    out.append([conv, place, role, text, letter])
                break

    def rest(out: list[list]) -> None:
        for k, letter in enumerate(letters):
            put_in(letter, out, at + 1 + k)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        made[3] = made[3].cast(pa.string())
        return pa.RecordBatch.from_arrays(made, names)

    for batch in batches:
        for start in range(0, len(batch), 256):
            out: list[list] = []
            messages(batch.slice(start, 256), out)
            if out:
                yield batch_of(out)
    out = []
    rest(out)
    yield batch_of(out)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's ``role:text`` lines, in order; nothing but the hash is held."""
    conv, digest = None, None
    for batch in batches:
        done = []
        for key, role, text in zip(batch.column(0).to_pylist(), cells(batch.column(2)), cells(batch.column(3)), strict=True):
            if digest is None or key != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(role + b":")
            digest.update(text)
        if done:
            yield pa.RecordBatch.from_pylist([{"conv": c, "sha256": d} for c, d in done])
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": digest.hexdigest()}])


class Repair(NamedTuple):
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. ``messages``: conv, place,
    role, text, edit, ordered by place within conv; edit is K, R or I."""

    conversations: DataFrame
    messages: DataFrame


def key_of(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("1"), conv.cast("string")), F.lit("0"))


def repair(rows: DataFrame) -> Repair:
    """Faults, cheapest edits and repaired messages of the conversations in ``rows`` (conv_id, turn, role, text).

    A null conv_id is a conversation of its own; null roles and texts count as one space. Rows stand by turn, nulls
    first, then by role and text, so ties and repeated rows have a defined order. A row's fault is blank (no character
    other than ASCII white space), else duplicate (role and text seen in an earlier row), else truncated (the last such
    character ends no sentence). Blank and duplicate rows are deleted. Of equally cheap repairs the one whose audit is
    least in ASCII counts. Texts of any length pass whole; other columns are not read; an empty table gives empty
    results. Runs when called, in tables under the shared folder.
    """
    importable(rows.sparkSession)
    space = F.lit(" ")
    named = rows.select(
        key_of(F.col("conv_id")).alias("conv"),
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(
        named.repartitionByRange(tasks, "conv", "turn", "role", F.substring("text", 1, SAMPLED))
        .sortWithinPartitions("conv", "turn", "role", "text")
        .withColumn("row", F.monotonically_increasing_id()),
        "dealt",
    )

    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.col("role").substr(1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    first = dealt.groupBy("conv", F.unhex(said).alias("said")).agg(F.min("row").alias("row"))
    facts = dealt.select(
        "conv",
        "row",
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
        place.alias("place"),
    )
    faults = (
        facts.join(first.select("row", F.lit(True).alias("first")), "row", "left")
        .withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("cut"))
    )
    letters = F.when(F.col("blank") | F.col("duplicate"), "SUAO").when(F.col("truncated"), "0123").otherwise("suao")
    lettered = faults.withColumn("letter", F.substr(letters, F.col("place"), F.lit(1)))
    ordered = F.array_sort(F.collect_list(F.struct("row", "letter")))
    pieces = written(
        lettered.groupBy("conv", F.shiftright("row", PIECE_BITS).alias("piece")).agg(
            F.min("row").alias("start"),
            F.array_join(F.transform(ordered, lambda r: r["letter"]), "").alias("codes"),
            *[F.count_if(name).alias(name) for name in ("blank", "duplicate", "truncated")],
        ),
        "pieces",
    )

    narrow = pieces.select("conv", "piece", "start", "codes")
    several = narrow.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    chained = _over(narrow.join(several, "conv", "left_semi").repartition("conv", "piece"), _crossings, "crossing array<bigint>")
    backward = chained.repartition("conv").sortWithinPartitions("conv", F.desc("piece"))
    priced = _over(backward, _beyond, "last boolean, beyond array<bigint>").drop("crossing").repartition("conv", "piece")
    turned = _over(priced, _turned, "turned array<bigint>")
    forward = turned.repartition("conv").sortWithinPartitions("conv", "piece")
    placed = _over(forward, _before, "before bigint, broken bigint").drop("turned").repartition("conv", "piece")
    whole = narrow.join(several, "conv", "left_anti").withColumns(
        {
            "last": F.lit(True),
            "beyond": F.array(*[F.lit(c).cast("long") for c in ACCEPTED]),
            "before": F.lit(START).cast("long"),
            "broken": F.lit(0).cast("long"),
        }
    )
    audited = written(
        _over(whole.unionByName(placed), _audited, "audit string, cost bigint, illegal bigint").drop("beyond", "broken"), "audits"
    )

    spelled = F.array_sort(F.collect_list(F.struct("piece", "audit")))
    edits = audited.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(spelled, lambda p: p["audit"]), "").alias("audit"),
    )
    counts = pieces.groupBy("conv").agg(*[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    spans = dealt.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    conversations = spans.join(counts, "conv").join(edits, "conv")

    nothing = F.lit(None).cast("string")
    script = audited.select(
        "conv", "piece", (GAP * F.col("start")).alias("place"), nothing.alias("role"), nothing.alias("text"), "audit", "before"
    )
    spoken = dealt.select(
        "conv",
        F.shiftright("row", PIECE_BITS).alias("piece"),
        (GAP * F.col("row") + 4).alias("place"),
        "role",
        "text",
        nothing.alias("audit"),
        F.lit(None).cast("long").alias("before"),
    )
    played = script.unionByName(spoken).repartition("conv", "piece").sortWithinPartitions("conv", "place")
    messages = played.mapInArrow(_told, "conv string, place bigint, role string, text string, edit string")
    return Repair(conversations, messages)


def digests(messages: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired ``role:text`` lines, for conversations that have any."""
    ordered = messages.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "place", "role", "text")
    return ordered.mapInArrow(_hashed, "conv string, sha256 string")
