"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries of the digests, one per task and then merged, name at most ``HEAVY`` digests; every
digest on more than 1/(HEAVY+1) of the rows is among them. Their winners are then counted exactly, reduced
on the map side to one row per task and digest, and the counted winners are broadcast (HEAVY rows at
most), so rows of heavy digests are decided where they stand. The other digests, each too rare to fill a
task, are shuffled and decided in a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanout.llm.shared import importable, lower_ascii, small, written

HEAVY = 4096


def summarised(digests: Iterable[bytes], size: int) -> dict[bytes, int]:
    """Misra-Gries: at most ``size`` counters, each at most count/(size+1) below the true frequency."""
    counters: dict[bytes, int] = {}
    for value in digests:
        if value in counters:
            counters[value] += 1
        elif len(counters) < size:
            counters[value] = 1
        else:
            counters = {k: c - 1 for k, c in counters.items() if c > 1}
    return counters


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = summarised((v for b in batches for v in b.column(0).to_pylist()), HEAVY)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["digest", "least"]
    )


def _merged(summaries: DataFrame) -> DataFrame:
    """One summary of all: counters add up, and the (HEAVY+1)-th largest is taken off each."""
    added = summaries.groupBy("digest").agg(F.sum("least").alias("least"))
    top = added.orderBy(F.desc("least"), "digest").limit(HEAVY + 1)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("least"), "digest")))
    cut = ranked.agg(F.coalesce(F.max(F.when(F.col("place") > HEAVY, F.col("least"))), F.lit(0)).alias("cut"))
    return ranked.join(F.broadcast(cut)).filter("place <= %d and least > cut" % HEAVY).select("digest")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A to Z; null counts as empty. The row with the
    largest doc_id stays (a null doc_id is less than any); of several rows with that doc_id and equal
    texts, exactly one is kept. Other columns are not read. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    digest = F.unhex(F.sha2(lower_ascii(F.col("text")), 256))
    rows = written(
        docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    heavy = written(_merged(rows.select("digest").mapInArrow(_summaries, "digest binary, least bigint")), "heavy")
    place = F.struct("doc_id", "row")
    winners = written(
        rows.join(F.broadcast(heavy), "digest")
        .groupBy("digest")
        .agg(F.max(place).alias("best"), F.count("*").alias("group_size")),
        "winners",
    )
    marked = rows.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    rest = (
        marked.filter("group_size is null")
        .drop("best", "group_size")
        .withColumns({"best": F.max(place).over(same), "group_size": F.count("*").over(same)})
    )
    decided = marked.filter("group_size is not null").unionByName(rest)
    return decided.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of identical rows one.

    Rows go by (doc_id, digest), so texts are not shuffled while few go; only repeated rows are brought together.
    """
    mine, own = "__text_sha256", "__doc_id"
    found = exact_groups(docs).groupBy(F.col("doc_id").alias(own), "text_sha256").agg(
        F.max("kept").alias("kept"), F.count("*").alias("rows")
    )
    found = written(found.filter("not kept or rows > 1"), "doubles")
    same = (F.col(mine) == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col(own))
    named = docs.withColumn(mine, F.sha2(lower_ascii(F.col("text")), 256))
    alone = named.join(small(found), same, "left_anti")
    again = named.join(small(written(found.filter("kept"), "again")), same, "left_semi")
    return alone.unionByName(again.dropDuplicates(["doc_id", mine])).drop(mine)
