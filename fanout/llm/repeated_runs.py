"""Exactly repeated runs of words, wherever they stand: across line breaks and inside longer lines.

A run is ``RUN`` words and more that stand elsewhere too, A to Z lower-cased and white space aside. Of every
``RUN`` consecutive words one block of ``BLOCK`` words at least is an anchor, chosen by the blocks' hashes alone,
so equal runs share an anchor. Only where an anchor occurs twice are all stretches of ``RUN`` words around it
hashed and counted; a stretch that occurs twice is a repeat, and repeats that touch are one run, as wide
as what is common. Each stretch's first occurrence stays, by doc_id and place; the words of the others go.
Equal texts are settled ahead, each but the first being one run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanout.llm.shared import cells, discard, freed, importable, likely, settled, small, written
from fanout.llm.words import Run, shingles, together, words_and_places

RUN = 50
BLOCK = 25
SPREAD = RUN - BLOCK + 1  # blocks in a run, one of which is an anchor
_RUNS = (
    "doc_id bigint, version bigint, first_word int, last_word int, paragraph int, "
    "keep_doc_id bigint, keep_paragraph int, copies bigint, removed boolean"
)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (a ufunc such as minimum) of every ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = least(out[:-have], out[have:]), 2 * have
    return least(out[: len(values) - width + 1], out[width - have :]) if width > have else out


def anchors(blocks: np.ndarray) -> np.ndarray:
    """Whether each block is the least, ties included, of some SPREAD consecutive ones."""
    least = _sliding(blocks, SPREAD, np.minimum)
    edge = np.zeros(SPREAD - 1, np.uint64)
    return _sliding(np.concatenate((edge, least, edge)), SPREAD, np.maximum) == blocks


def _blocks(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Every block's hash, by its first word, and the first words of those that are anchors in their text."""
    blocks = shingles(run.hashes, BLOCK)
    within = run.inside(BLOCK)
    # a least block of 0 makes none an anchor, as beyond the edges of a text
    chosen = anchors(np.where(within, blocks, np.uint64(0))) & within
    return blocks, np.flatnonzero(chosen & np.repeat(np.diff(run.bounds) >= RUN, np.diff(run.bounds))[: len(chosen)])


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for run in together(cells(batch.column(2))):
            before, first = first, first + len(run.bounds) - 1
            if len(run.hashes) < RUN:
                continue
            blocks, at = _blocks(run)
            if not len(at):
                continue
            text = np.searchsorted(run.bounds, at, "right") - 1
            values = blocks[at]
            order = np.lexsort((values, text))
            text, values = text[order], values[order]
            starts = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (values[1:] != values[:-1]))))
            rows = pa.array(before + text[starts], pa.int64())
            n = np.diff(np.append(starts, len(values))).astype(np.int32)
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(values[starts].view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "anchor", "n"])


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every RUN words around an anchor that is wanted: their hash, line and first word."""
    for batch in batches:
        first = 0
        for run in together(cells(batch.column(2))):
            before, first = first, first + len(run.bounds) - 1
            if len(run.hashes) < RUN:
                continue
            blocks, at = _blocks(run)
            wanted = batch.column(3).slice(before, first - before).flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(first - before), batch.column(3).slice(before, first - before).value_lengths().to_numpy())
            hit = at[_among(np.searchsorted(run.bounds, at, "right") - 1, blocks[at], owner, wanted)]
            own = run.bounds[np.searchsorted(run.bounds, hit, "right") - 1]
            near = np.bincount(np.maximum(hit - SPREAD + 1, own), minlength=len(run.hashes) + 1)
            near -= np.bincount(hit + 1, minlength=len(near))
            starts = np.flatnonzero((np.cumsum(near)[: len(run.hashes) - RUN + 1] > 0) & run.inside(RUN))
            if not len(starts):
                continue
            text = np.searchsorted(run.bounds, starts, "right") - 1
            breaks, hashes = run.breaks(), shingles(run.hashes, RUN)[starts].view(np.int64)
            lines = np.searchsorted(breaks, run.places[starts]) - np.searchsorted(breaks, run.begins[text])
            for a in range(0, len(starts), 50_000):
                part = slice(a, a + 50_000)
                rows = pa.array(before + text[part], pa.int64())
                columns = [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(lines[part], pa.int32()),
                    pa.array((starts - run.bounds[text])[part], pa.int32()),
                    pa.array(hashes[part]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "paragraph", "word", "stretch"])


def _among(text: np.ndarray, values: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is wanted in its text. ``owner``: the text of each wanted one."""
    order = np.lexsort((np.arange(len(values) + len(wanted)) < len(values), np.append(values, wanted), np.append(text, owner)))
    texts, every, own = np.append(text, owner)[order], np.append(values, wanted)[order], order < len(values)
    starts = np.concatenate(([True], (texts[1:] != texts[:-1]) | (every[1:] != every[:-1])))[: len(order)]
    found = np.empty(len(values), bool)
    found[order[own]] = ~own[np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))][own]
    return found


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touching repeats of one text and kind as one run; the first one says who keeps it.

    Rows come by doc_id, version, removed, first and last, a text's maybe in several batches.
    """
    open_run = None
    for batch in batches:
        if not len(batch):
            continue
        if open_run is not None:
            batch = pa.Table.from_batches([open_run, batch]).combine_chunks().to_batches()[0]
        ids, versions, removed, first, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (removed[1:] != removed[:-1])
        # the greatest last word so far of each text and kind: they rise from one to the next by more than any word's number
        beyond = (np.cumsum(new) - 1) * (1 << 32)
        reach = np.maximum.accumulate(last + beyond) - beyond
        new[1:] |= first[1:] > reach[:-1] + 1
        starts = np.flatnonzero(new)
        ends = reach[np.append(starts[1:], len(ids)) - 1]
        runs = batch.take(pa.array(starts))
        runs = runs.set_column(4, batch.schema.field(4), pa.array(ends.astype(np.int32)))
        open_run = runs.slice(len(starts) - 1)
        yield _told(runs.slice(0, len(starts) - 1))
    if open_run is not None:
        yield _told(open_run)


def _told(runs: pa.RecordBatch) -> pa.RecordBatch:
    columns = [runs.column(n) for n in ("doc_id", "version", "first", "last", "paragraph", "keep_doc_id", "keep_paragraph", "copies", "removed")]
    names = ["doc_id", "version", "first_word", "last_word", "paragraph", "keep_doc_id", "keep_paragraph", "copies", "removed"]
    return pa.RecordBatch.from_arrays(columns, names)


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, line = [], []
        for text in cells(batch.column(2)):
            places = words_and_places(text)[1]
            n.append(len(places))
            line.append(text.count(b"\n", 0, int(places[0])) if len(places) else 0)
        columns = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(line, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_words", "paragraph"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """One row per run that stands elsewhere, and one per run that stays for others.

    doc_id, version (xxhash64 of the text), first_word and last_word (from 0), paragraph (the line of the first
    word), keep_doc_id and keep_paragraph (where the first stretch of the run stays), copies (of that stretch, in
    different texts or places; documents of equal text for a whole text) and removed. Null and empty texts have
    none; rows without doc_id are left whole; a row that occurs twice is one document.
    """
    importable(docs.sparkSession)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    same = texts.select("doc_id", "version", F.md5("text").alias("whole")).distinct()
    firsts = same.groupBy("whole").agg(F.min("doc_id").alias("keep_doc_id"), F.count("*").alias("copies")).filter("copies > 1")
    equal = written(same.join(firsts, "whole").select("doc_id", "version", "keep_doc_id", "copies"), "equal")
    gone = small(equal.filter("doc_id != keep_doc_id"))
    once = texts.join(gone, ["doc_id", "version"], "left_anti")

    found = written(once.mapInArrow(freed(_anchors), "doc_id bigint, version bigint, anchor bigint, n int"), "anchors")
    shared = written(found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "shared")
    wanted = likely(found, "anchor", shared).join(shared, "anchor", "left_semi")
    wanted = written(wanted.groupBy("doc_id", "version").agg(F.collect_set("anchor").alias("wanted")), "wanted")
    discard(found, shared)
    met = likely(once, "doc_id", wanted).join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "wanted")
    stretches = "doc_id bigint, version bigint, paragraph int, word int, stretch bigint"
    stretched = written(met.mapInArrow(freed(_stretches), stretches), "stretches")
    discard(wanted)

    place = F.struct("doc_id", "paragraph", "version", "word")
    counted = stretched.groupBy("stretch").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("copies"))
    repeats = stretched.join(counted.filter("lo != hi").drop("hi"), "stretch")
    # an occurrence that overlaps the one that stays gives up only what lies beyond it
    beyond = (F.col("lo.doc_id") == F.col("doc_id")) & (F.col("lo.version") == F.col("version"))
    beyond &= place != F.col("lo")
    first = F.when(beyond, F.greatest("word", F.col("lo.word") + RUN)).otherwise(F.col("word"))
    by_text = repeats.select(
        "doc_id", "version", (place != F.col("lo")).alias("removed"), first.cast("int").alias("first"), (F.col("word") + RUN - 1).alias("last"),
        "paragraph", F.col("lo.doc_id").alias("keep_doc_id"), F.col("lo.paragraph").alias("keep_paragraph"), "copies",
    )
    by_text = by_text.filter("first <= last").repartition("doc_id", "version")
    merged = by_text.sortWithinPartitions("doc_id", "version", "removed", "first", "last").mapInArrow(freed(_merged), _RUNS)

    alike = likely(texts, "doc_id", equal).join(equal.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi")
    sizes = alike.mapInArrow(freed(_lengths), "doc_id bigint, version bigint, n_words int, paragraph int").distinct()
    whole = equal.join(sizes.filter(F.col("n_words") >= RUN), ["doc_id", "version"]).select(
        "doc_id", "version", F.lit(0).alias("first_word"), (F.col("n_words") - 1).alias("last_word"), "paragraph",
        "keep_doc_id", F.col("paragraph").alias("keep_paragraph"), "copies", (F.col("doc_id") != F.col("keep_doc_id")).alias("removed"),
    )
    return merged.unionByName(whole)


def cut(text: bytes, spans: Iterable[tuple[int, int]]) -> bytes:
    """A text without some words, given by first and last; where they stood, the gap that breaks most lines stays."""
    _, places = words_and_places(text)
    ends = [*places.tolist()[1:], len(text)]
    out, at = b"", 0
    for first, last in sorted(spans):
        left = (out + text[at : places[first]]) if first else b""
        bare = left.rstrip(b" \t\n\v\f\r")
        end = ends[last]
        word_end = len(text[:end].rstrip(b" \t\n\v\f\r"))
        before, after = left[len(bare) :], text[word_end:end]
        gap = after if after.count(b"\n") > before.count(b"\n") else before
        if last + 1 == len(places):
            gap = b""
        out, at = bare + (gap if bare else b""), end
    return out + text[at:]


def without_runs(docs: DataFrame) -> DataFrame:
    """``docs`` without the runs that are to go, and n_chars counted anew where text changed."""

    @F.arrow_udf("string")
    def shortened(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(cells(text), spans, strict=True):
            out.append(cut(t, [(x["first"], x["last"]) for x in s.as_py()]).decode(errors="replace") if s.is_valid else None)
        return pa.array(out, pa.string())

    def removed() -> DataFrame:
        return (
            repeated_runs(docs)
            .filter("removed")
            .groupBy(F.col("doc_id").alias("__doc_id"), F.col("version").alias("__version"))
            .agg(F.collect_set(F.struct(F.col("first_word").alias("first"), F.col("last_word").alias("last"))).alias("__spans"))
        )

    gone = small(settled(removed, "gone"))
    met = (F.col("doc_id") == F.col("__doc_id")) & (F.xxhash64("text") == F.col("__version"))
    marked = docs.join(gone, met, "left")
    cleaned = F.when(F.col("__spans").isNull(), F.lit(None)).otherwise(F.col("text"))
    changed = marked.withColumn("__cut", shortened(cleaned, F.col("__spans")))
    changed = changed.withColumn("text", F.coalesce("__cut", "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        changed = changed.withColumn("n_chars", counted)
    return changed.select(docs.columns)
