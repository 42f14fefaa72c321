"""Quotation linking, in DataFrame functions only: who answers whom, and messages without their quotes.

A line's quote level is the number of ``>`` signs in front of it. Quoted lines and the messages' own lines
are normalised and hashed; a quoted line links to the latest earlier message of its conversation with
that line of its own. Lines that mail programs wrapped anew have no equal line: consecutive lines of one level
are a passage, whose whole, sentences and runs of ``SHINGLE`` words are hashed too, and a line without
a link of its own takes the one of most such parts that touch it. A message answers the message
that most of its outermost quotes, those of its least level, link to. Threads
then follow by doubling: a message's path is its ancestors' turns, so sorting by path gives each message
right after what it answers, and no conversation is ever gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanout.llm.shared import UPPER, written

MARKS = r"^((?:[ \t]*>)+)"
SHINGLE = 5


def _lines(messages: DataFrame) -> DataFrame:
    """One row per line: its place, level, bare text and hash (null for lines without words)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    lines = messages.select("conv_id", "turn", "row", F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    bare = F.regexp_replace("line", MARKS + "[ \t]?", "")
    normal = F.trim(F.regexp_replace(F.translate(bare, UPPER, UPPER.lower()), r"\s+", " "))
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return lines.select(
        "conv_id",
        "turn",
        "row",
        "place",
        level.alias("level"),
        bare.alias("bare"),
        normal.alias("normal"),
        F.when(F.length(normal) > 0, F.sha2(normal, 256)).alias("digest"),
    )


def _parts(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, row, digest, first, last): passages, their sentences and runs of words, by their lines."""
    in_order = Window.partitionBy("row").orderBy("place")
    before = F.lag(F.struct("place", "level")).over(in_order)
    starts = before.isNull() | (before["place"] != F.col("place") - 1) | (before["level"] != F.col("level"))
    passages = (
        lines.filter("digest is not null")
        .withColumn("starts", starts.cast("int"))
        .withColumn("passage", F.sum("starts").over(in_order))
        .groupBy("conv_id", "turn", "row", "passage")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.split("normal", " ").alias("words")))).alias("parts"))
    )
    words = F.flatten(F.transform("parts", lambda x: x["words"]))
    places = F.flatten(F.transform("parts", lambda x: F.transform(x["words"], lambda _: x["place"])))
    held = passages.select("conv_id", "turn", "row", words.alias("words"), places.alias("places"), F.size(words).alias("n"))

    def part(start: Column, n: Column) -> Column:  # start from 0
        text = F.array_join(F.slice("words", start + 1, n), " ")
        return F.struct(
            F.sha2(text, 256).alias("digest"),
            F.get("places", start).alias("first"),
            F.get("places", start + n - 1).alias("last"),
        )

    ends = F.filter(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: (i == F.col("n")) | F.get("words", i - 1).rlike(r"[.!?][\"')\]]*$"),
    )
    held = held.withColumn("ends", ends)
    begin = lambda j: F.when(j > 0, F.get("ends", j - 1)).otherwise(F.lit(0))
    sentences = F.transform("ends", lambda e, j: part(begin(j), e - begin(j)))
    runs = F.when(
        F.col("n") >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - SHINGLE, F.lit(0))), lambda i: part(i, F.lit(SHINGLE))),
    )
    none = F.array().cast("array<struct<digest:string,first:int,last:int>>")
    every = F.concat(F.array(part(F.lit(0), F.col("n"))), sentences, F.coalesce(runs, none))
    return held.select("conv_id", "turn", "row", F.inline(every))


def _sources(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, source): the latest turn before each quoting one that has the digest as its own.

    One running maximum over the turns that share a digest: own ones and quotes of it are reduced to one row a
    turn first, and only digests that some message quotes take part.
    """
    turns = quoted.select("conv_id", "digest", "turn").distinct()
    asked = turns.select("conv_id", "digest").distinct()
    sources = own.select("conv_id", "digest", "turn").distinct().join(asked, ["conv_id", "digest"], "left_semi")
    known = sources.withColumn("source", F.col("turn")).unionByName(
        turns.withColumn("source", F.lit(None).cast("bigint"))
    )
    earlier = (
        Window.partitionBy("conv_id", "digest").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        known.withColumn("source", F.max("source").over(earlier))
        .groupBy("conv_id", "digest", "turn")
        .agg(F.max("source").alias("source"))
    )


def _links(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, row, place, level, source): the latest earlier turn that says the quoted line itself.

    A line that nobody has so takes the turn that most parts of its passage around it link to, the latest of these.
    """
    own, quoted = lines.filter("level = 0 and digest is not null"), lines.filter("level > 0 and digest is not null")
    exact = quoted.join(_sources(own, quoted), ["conv_id", "digest", "turn"], "left")
    exact = written(exact.select("conv_id", "turn", "row", "place", "level", "source"), "quotes")

    apart = exact.filter("source is null").select("conv_id", "row", "place")
    asking = apart.select("conv_id").distinct()
    rewrapped = written(_parts(quoted.join(apart.select("row").distinct(), "row", "left_semi")), "parts")
    said = own.join(asking, "conv_id", "left_semi")
    units = _parts(said).select("conv_id", "digest", "turn").unionByName(said.select("conv_id", "digest", "turn"))
    found = _sources(units, rewrapped).filter("source is not null")
    votes = (
        rewrapped.join(found, ["conv_id", "digest", "turn"])
        .select("row", "source", F.explode(F.sequence("first", "last")).alias("place"))
        .groupBy("row", "place", "source")
        .agg(F.count("*").alias("votes"))
        .groupBy("row", "place")
        .agg(F.max_by("source", F.struct("votes", "source")).alias("touched"))
    )
    linked = exact.join(votes, ["row", "place"], "left")
    return linked.select("conv_id", "turn", "row", "place", "level", F.coalesce("source", "touched").alias("source"))


def _paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path): the ancestors' turns and its own, joined by doubling the known stretch."""
    padded = lambda c: F.lpad(c.cast("string"), 12, "0")
    state = written(
        parents.filter("parent is not null").select("conv_id", "turn", "parent", padded(F.col("turn")).alias("path")),
        "threads",
    )
    done = None
    while state.filter("parent is not null").limit(1).count():
        above = state.select(
            "conv_id", F.col("turn").alias("parent"), F.col("parent").alias("next"), F.col("path").alias("before")
        )
        # a parent without a row of its own answers nothing: it ends the path
        joined = state.join(above, ["conv_id", "parent"], "left")
        top = F.coalesce("before", padded(F.col("parent")))
        state = written(
            joined.select(
                "conv_id",
                "turn",
                F.col("next").alias("parent"),
                F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat_ws("/", top, "path")).alias("path"),
            ),
            "threads",
        )
        done = state
    return (state if done is None else done).select("conv_id", "turn", "path")


def linked_messages(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages``: conv_id, turn, role, parent_turn, path, quoted_lines, linked_lines, max_level,
    reply.

    ``reply`` is the text without quoted lines and without the blank lines around it. parent_turn is null for
    a message whose outermost quotes link to no earlier message; ties go to the latest. Sorting by
    conv_id and path gives the conversation in reply order. Null text counts as empty; rows without conv_id or
    turn link to nothing and have no path; rows of one turn share its path. Other columns are not read. An
    empty table gives no rows.
    """
    rows = written(
        messages.select("conv_id", "turn", "role", "text").withColumn("row", F.monotonically_increasing_id()),
        "messages",
    )
    lines = _lines(rows)
    links = written(_links(lines.filter("conv_id is not null and turn is not null")), "quotes")
    least = links.groupBy("row").agg(F.min("level").alias("least"))
    outer = links.join(least, "row").filter("level = least and source is not null")
    votes = outer.groupBy("conv_id", "turn", "source").agg(F.count("*").alias("votes"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct("votes", "source")).alias("parent"))
    parents = written(parents, "parents")
    paths = _paths(parents)
    counted = links.groupBy("row").agg(
        F.count("*").alias("quoted_lines"), F.count("source").alias("linked_lines"), F.max("level").alias("max_level")
    )
    return (
        rows.join(parents, ["conv_id", "turn"], "left")
        .join(paths, ["conv_id", "turn"], "left")
        .join(counted, "row", "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.col("parent").alias("parent_turn"),
            F.coalesce("path", F.lpad(F.col("turn").cast("string"), 12, "0")).alias("path"),
            F.coalesce("quoted_lines", F.lit(0)).alias("quoted_lines"),
            F.coalesce("linked_lines", F.lit(0)).alias("linked_lines"),
            F.coalesce("max_level", F.lit(0)).alias("max_level"),
            unquoted(F.col("text")).alias("reply"),
        )
    )


def unquoted(text: Column) -> Column:
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    own = F.filter(F.split(whole, "\n", -1), lambda line: ~line.rlike(MARKS))
    return F.regexp_replace(F.array_join(own, "\n"), r"^[ \t]*\n(?:[ \t]*\n)*|(?:\n[ \t]*)+$", "")
