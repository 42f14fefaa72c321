"""Repeated passages: paragraph MinHash banding, exact verification, removal by components.

A paragraph is a line of a text; those of ``MIN_WORDS`` words and more are compared. Equal paragraphs are
one from the first shuffle on. The others collide through band keys, whose number is tuned so that a pair
at the threshold meets with probability ``RECALL``; every colliding pair that the components do not
yet explain is verified on its whole shingle sets (``set_links``). Of each component one paragraph
stays, its first by doc_id and place; the others go. Passages that are no lines, that run over several
or stand inside a longer one, are found by ``repeated_runs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanout.llm.repeated_runs import repeated_runs, without_runs
from fanout.llm.set_links import SETS, linked, made
from fanout.llm.shared import cells, freed, importable, likely, settled, small, written
from fanout.llm.signature_tree import COARSE, width_for
from fanout.llm.words import Run, digest, distinct, mixed, packed, shingle_set, shingles, together

MIN_WORDS = 50
WIDTH = 5
SIMILAR = (80, 100)
RECALL = 0.9999
PARAGRAPHS = "doc_id bigint, version bigint, paragraph int, n_words int, digest binary, n bigint, bits binary, bands array<bigint>"


def bands_for(similarity: float, recall: float, rows: int = 3) -> int:
    """Bands of ``rows`` minima each, so many that a pair of that similarity meets with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


ROWS = 3
BANDS = bands_for(SIMILAR[0] / SIMILAR[1], RECALL, ROWS)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 7) | np.uint64(1)


def band_keys(values: np.ndarray, starts: Sequence[int] | np.ndarray = (0,)) -> np.ndarray:
    """Each set's keys in turn; sets stand one after the other in ``values``, from ``starts`` on."""
    least = [np.minimum.reduceat((values ^ seed) * factor, starts) for seed, factor in zip(_SEEDS, _FACTORS, strict=True)]
    least = np.stack(least, axis=1).reshape(len(starts), BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = mixed(keys + least[:, :, j])
    return keys.ravel().view(np.int64)


def _bitmaps(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``signature_tree.bitmap`` of each set, COARSE bits a token."""
    widths = np.array([width_for(n, COARSE) for n in sizes.tolist()], np.int64)
    ends = np.cumsum(widths)
    flags = np.zeros(int(ends[-1]), np.uint8)
    low = (values & np.repeat(widths - 1, sizes).astype(np.uint64)).astype(np.int64)
    flags[low + np.repeat(ends - widths, sizes)] = 1
    data = np.packbits(flags, bitorder="little").tobytes()
    return [data[a:b] for a, b in zip(((ends - widths) // 8).tolist(), (ends // 8).tolist(), strict=True)]


def _long_lines(run: Run) -> tuple[np.ndarray, ...]:
    """Of every line of MIN_WORDS words and more: its text's number in the run, its own in the text, first and last + 1 word."""
    breaks = run.breaks()
    begins = np.concatenate(([0], breaks + 1))
    words = np.concatenate(([0], np.searchsorted(run.places, breaks), [len(run.hashes)]))
    long = np.flatnonzero(np.diff(words) >= MIN_WORDS)
    texts = np.searchsorted(run.begins, begins[long], "right") - 1
    return texts, long - np.searchsorted(begins, run.begins[texts]), words[long], words[long + 1]


def _paragraphs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for run in together(cells(batch.column(1))):
            texts, numbers, starts, ends = _long_lines(run)
            rows = pa.array(first + texts, pa.int64())
            first += len(run.bounds) - 1
            if not len(texts):
                continue
            every, sets, digests = shingles(run.hashes, WIDTH), [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                sets.append(distinct(every[a : b - WIDTH + 1]))
                digests.append(digest(run.hashes[a:b]))
            sizes = np.array([len(v) for v in sets])
            values, at = np.concatenate(sets), np.cumsum(sizes) - sizes
            offsets = pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(2).take(rows),
                    pa.array(numbers, pa.int32()),
                    pa.array(ends - starts, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(_bitmaps(values, at, sizes), pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(band_keys(values, at))),
                ],
                ["doc_id", "version", "paragraph", "n_words", "digest", "n", "bits", "bands"],
            )


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, values = [], []
        for text, wanted in zip(cells(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            lines = text.split(b"\n")
            for w in wanted:
                ids.append(w["id"])
                values.append(packed(shingle_set(lines[w["paragraph"]], WIDTH)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["id", "values"])


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph that has a like one elsewhere, the one that stays included.

    doc_id, version (xxhash64 of the text), paragraph (from 0), n_words, keep_doc_id, keep_paragraph (which
    one stays for it), copies (paragraphs of its component) and removed. Paragraphs are alike when their
    sets of five-word shingles, A to Z lower-cased, have a Jaccard of 0.8 or more. Documents without
    a like paragraph have no row. Null and empty texts have no paragraphs; rows without doc_id are left
    whole; a row that occurs twice is one document. Other columns are not read.
    """
    importable(docs.sparkSession)
    texts = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("version"))
    found = written(texts.mapInArrow(freed(_paragraphs), PARAGRAPHS), "paragraphs")
    place = F.struct("doc_id", "paragraph", "version")
    distinct = written(
        found.groupBy("digest")
        .agg(
            F.min(place).alias("first"),
            F.count("*").alias("copies"),
            *[F.any_value(c).alias(c) for c in ("n", "bits", "bands")],
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "distinct",
    )
    entries = distinct.select(F.explode("bands").alias("key"), "id", "n", F.col("n").alias("rest"))

    def sets_of(ids: DataFrame, then: Callable | None = None, schema: str = SETS) -> DataFrame:
        wanted = (
            distinct.join(ids, "id", "left_semi")
            .select("first.doc_id", "first.version", F.struct(F.col("first.paragraph").alias("paragraph"), "id").alias("w"))
            .groupBy("doc_id", "version")
            .agg(F.collect_list("w").alias("wanted"))
        )
        wanted = written(wanted, "wanted")
        once = likely(texts, "doc_id", wanted).join(wanted, ["doc_id", "version"]).select("text", "wanted")
        return once.mapInArrow(freed(made(_sets, then)), schema)

    roots = linked(entries, distinct.select("id", "n", "bits"), sets_of, *SIMILAR)
    owned = distinct.select("digest", "id", "first", "copies").join(roots, "id", "left")
    owned = owned.withColumn("root", F.coalesce("root", "id"))
    groups = (
        owned.groupBy("root").agg(F.min("first").alias("keep"), F.sum("copies").alias("copies")).filter("copies > 1")
    )
    members = owned.select("digest", "root").join(groups, "root").select("digest", "keep", "copies")
    return found.join(members, "digest").select(
        "doc_id",
        "version",
        "paragraph",
        "n_words",
        F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.paragraph").alias("keep_paragraph"),
        "copies",
        (place != F.col("keep")).alias("removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed paragraphs gone from text, and n_chars counted anew where text changed."""

    def removed() -> DataFrame:
        return (
            repeated_paragraphs(docs)
            .filter("removed")
            .groupBy(F.col("doc_id").alias("__doc_id"), F.col("version").alias("__version"))
            .agg(F.collect_set("paragraph").alias("__gone"))
        )

    gone = small(settled(removed, "gone"))
    marked = docs.join(
        gone, (docs["doc_id"] == F.col("__doc_id")) & (F.xxhash64(docs["text"]) == F.col("__version")), "left"
    )
    lines = F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(F.array_join(lines, "\n"))
    changed = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        changed = changed.withColumn("n_chars", counted)
    return changed.select(docs.columns)


def repeats(docs: DataFrame) -> DataFrame:
    """Rows of ``repeated_paragraphs`` (kind ``paragraph``) and of ``repeated_runs`` (kind ``run``).

    A run's n_words counts its own words; first_word, its first word's number in the text, is null for paragraphs.
    """
    lines = repeated_paragraphs(docs).withColumns({"kind": F.lit("paragraph"), "first_word": F.lit(None).cast("int")})
    found = repeated_runs(docs).withColumns(
        {"kind": F.lit("run"), "n_words": F.col("last_word") - F.col("first_word") + 1}
    )
    return lines.unionByName(found.select(lines.columns))


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed paragraphs and then without the repeated runs of what is left."""
    return without_runs(without_repeats(docs))
