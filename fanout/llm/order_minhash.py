"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are its runs of ``K`` words, numbered by occurrence within the text, so a repeated k-mer
counts as often as it stands there. Hash classes pick one least numbered k-mer each; the least k-mers of
two classes make a tuple, hashed in text order. Equal tuples are thus evidence for common k-mers that
also stand in the same order, which edit distance is about and plain MinHash is not.

Documents are dealt once, by ranges of doc_id, so a document and its successor are in one partition; all
later steps group by that range and its rows and need no other shuffle of texts or k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanout.llm.shared import written

K = 3
TUPLES = 32
PLACE_BITS = 26  # of a word's place in the text, in the low bits of a k-mer's rank
SPACE = " \t\n\x0b\x0c\r"
RANGES_PER_PARTITION = 4
CELLS = 256


def _kmers(text: Column) -> Column:
    """Hashes of all runs of K words in text order; fewer words make one run; no words none."""
    bare = F.trim(text, F.lit(SPACE))
    words = F.when(F.length(bare) > 0, F.split(bare, f"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))
    runs = F.transform(
        F.array(words),  # as a lambda variable, the words are split once and not for each k-mer
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]),
            ),
        ),
    )
    return F.get(runs, F.lit(0))


def _ranges(docs: DataFrame, wanted: int) -> Column:
    """Which of about ``wanted`` ranges of doc_id a row lies in; ranges are in doc_id order and hold about as many rows.

    Quantiles cut doc_id into cells, and each cell is cut evenly. The search for the cell is a tree of plain
    comparisons, as lambdas would keep plans that use it twice from sharing one shuffle.
    """
    cells = min(wanted, CELLS)
    known = docs.filter("doc_id is not null")
    cuts = known.agg(
        F.min("doc_id"), F.percentile_approx("doc_id", [i / cells for i in range(1, cells + 1)], 50 * cells)
    ).first()
    bounds = sorted({cuts[0], *(cuts[1] or [])} - {None})
    if len(bounds) < 2:
        return F.lit(0)
    id_, each = F.col("doc_id"), -(-wanted // cells)

    def inside(i: int) -> Column:
        """The range of an id from bounds[i] up to bounds[i + 1]; ids outside all bounds go to the end cells."""
        lo, hi = bounds[i], bounds[i + 1]
        share = F.floor((id_ - lo).cast("double") / float(hi - lo) * each).cast("int")
        return F.greatest(F.lit(i * each), F.least(F.lit((i + 1) * each - 1), share + i * each))

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return inside(lo)
        mid = (lo + hi) // 2
        return F.when(id_ < bounds[mid], search(lo, mid)).otherwise(search(mid, hi))

    # never null, so that no plan that uses it infers a filter which another one lacks
    return F.coalesce(F.when(id_.isNotNull(), search(0, len(bounds) - 1)), F.lit(0))


def _with_next(docs: DataFrame) -> DataFrame:
    """(part, place, doc_id, text, next), places from 1 in doc_id order; after the last comes the first.

    Each range also gets the first row of the next range that has any, with ``doc_id`` order kept by ``extra``.
    """
    tasks = RANGES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = _ranges(docs, 2 * tasks)
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("extra"), part.alias("part"))
    starts = docs.select("doc_id", part.alias("part")).groupBy("part").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    )
    before = Window.orderBy("part")
    linked = written(
        starts.select(
            F.coalesce(F.lag("part").over(before), F.max("part").over(Window.partitionBy())).alias("into"),
            F.col("first.doc_id").alias("first"),
            F.col("part").alias("from"),
        ),
        "starts",
    )
    guests = ranged.join(
        F.broadcast(linked), (F.col("part") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("first"))
    ).select("doc_id", "text", F.lit(1).alias("extra"), F.coalesce("into", F.lit(0)).alias("part"))
    inside = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    # as many partitions as asked for: each text becomes hundreds of rows, which its bytes do not show
    return ranged.unionByName(guests).repartition(tasks, "part").select(
        "part",
        F.row_number().over(inside).alias("place"),
        "extra",
        "doc_id",
        "text",
        F.lead("text").over(inside).alias("next"),
    )


def _edited(text: Column, after: Column) -> Column:
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def signatures(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature): per text up to TUPLES longs, slot number above a 32-bit tuple hash.

    ``texts`` has the keys and ``text``, and its rows differ in their keys. Partitioning by the first key is
    kept. Texts without words have no row.
    """
    rows = texts.select(*keys, F.posexplode(_kmers(F.col("text"))).alias("at", "kmer"))
    same = Window.partitionBy("kmer", *keys).orderBy("at")
    ranked = F.xxhash64("kmer", F.row_number().over(same))
    low = (1 << PLACE_BITS) - 1
    picked = rows.select(*keys, ranked.alias("rank"), F.least("at", F.lit(low)).alias("at")).select(
        *keys,
        F.pmod("rank", F.lit(TUPLES)).cast("int").alias("slot"),
        F.shiftright("rank", 8).bitwiseAND(F.lit(1)).alias("half"),
        F.col("rank").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("at")).alias("least"),
    )
    tuples = picked.groupBy(*keys, "slot").agg(
        F.min(F.when(F.col("half") == 0, F.col("least"))).alias("x"),
        F.min(F.when(F.col("half") == 1, F.col("least"))).alias("y"),
    )
    at = lambda c: F.col(c).bitwiseAND(F.lit(low))
    bare = lambda c: F.shiftright(c, PLACE_BITS)
    order = F.coalesce(at("x") <= at("y"), F.lit(True))
    hashed = F.when(order, F.xxhash64(F.lit(0), bare("x"), F.lit(1), bare("y"))).otherwise(
        F.xxhash64(F.lit(2), bare("y"), F.lit(3), bare("x"))
    )
    short = hashed.bitwiseAND(F.lit(0xFFFFFFFF))
    slot = F.shiftleft(F.col("slot").cast("bigint"), 32).bitwiseOR(short)
    return tuples.groupBy(*keys).agg(F.sort_array(F.collect_list(slot)).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples among the slots that either fingerprint has; 1 for two without any."""
    slots = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(slots(a), slots(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def written_out(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has the last floor(n_chars/2) characters replaced by the first as many (or all) of the
    next document in ascending doc_id; after the last comes the first. Null text counts as empty; a null doc_id
    comes before all others; equal doc_ids follow each other by text. Texts without words have an empty
    fingerprint, and two of those are alike with 1. Other columns are not read.
    """
    rows = _with_next(docs)
    whole = rows.select(
        "part", "place", "extra", "doc_id", "text", F.when(F.col("extra") == 0, _edited(F.col("text"), F.col("next"))).alias("edited")
    )
    both = whole.select(
        "part", F.explode(F.array(
            F.struct((F.col("place") * 2).cast("bigint").alias("one"), F.col("text").alias("text")),
            F.struct((F.col("place") * 2 + 1).cast("bigint").alias("one"), F.col("edited").alias("text")),
        )).alias("v"),
    ).select("part", "v.one", "v.text").filter("text is not null")
    signed = signatures(both, ["part", "one"])
    paired = signed.groupBy("part", F.expr("cast(one div 2 as int)").alias("place")).agg(
        F.max(F.when(F.col("one") % 2 == 0, F.col("signature"))).alias("own"),
        F.max(F.when(F.col("one") % 2 == 1, F.col("signature"))).alias("changed"),
    )
    facts = whole.select(
        "part", "place", "extra", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    none = F.array().cast("array<bigint>")
    joined = facts.join(paired, ["part", "place"], "left").select(
        *facts.columns, F.coalesce("own", none).alias("own"), F.coalesce("changed", none).alias("changed")
    )
    after = F.lead("own").over(Window.partitionBy("part").orderBy("place"))
    return joined.withColumn("after", after).filter("extra = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written_out(F.col("own")).alias("fingerprint"),
        written_out(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
