"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its site is like.

A logistic classifier over style measures gives each document a log-likelihood ratio. Host and path rates
of good documents are posterior means of beta-binomial models whose strengths are fitted by moments over
all hosts and all paths, so a site with few documents stays near the rate above it. Both levels are grouped
sums; the decision adds the path's prior log-odds to the document's evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout.llm.shared import cells, freed, importable, small, written

TRAINED_ON = 20_000  # labelled documents at most, those with the least xxhash64(doc_id)
PENALTY = 1e-3
STEPS = 60
FEW_WORDS = 5  # half of a document's evidence counts when it has so many words
EVIDENCE = 12.0  # bound on a document's log-likelihood ratio, either way
KEEP_FROM = 0.5
_JUNK = re.compile(rb"[^\w\s.,;:'\"()?-]+")
_LETTERS = re.compile(rb"[^\x00-\x20.,;:'\"()?!0-9-]+")
MEASURES = [
    "repeated_next", "distinct", "top_word", "capital_words", "symbol_words", "bars", "bangs", "digits",
    "mean_length", "long_words", "log_words", "junk_line_words", "worst_line", "same_lines", "empty",
]


def _line(words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Repeats of the word before, words in capitals, words with symbols, bars, and with bangs."""
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    capitals = sum(len(w) > 1 and w.isupper() for w in words)
    joined = b" ".join(words)
    bars = words.count(b"|")
    symbols = len(_JUNK.findall(joined.replace(b"!", b""))) - bars
    return repeated, capitals, symbols, bars, joined.count(b"!!")


def measures(text: bytes) -> list[float]:
    """Shares between 0 and 1 but for the mean word length and the logarithm of the number of words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(MEASURES) - 1) + [1.0]
    lines = [w for w in map(bytes.split, text.split(b"\n")) if w]
    totals, junk, worst = np.zeros(5), 0, 0.0
    for line in lines:
        found = _line(line)
        totals += found
        bad = max(found) / len(line)
        if bad > 0.25 and len(line) >= 4:
            junk += len(line)
            worst = max(worst, bad)
    counts = Counter(words)
    repeated, capitals, symbols, bars, bangs = (totals / n).tolist()
    same = 1 - len(set(map(tuple, lines))) / len(lines)
    long = sum(len(w) > 18 for w in words) / n
    digits = sum(map(text.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / len(text)
    return [
        repeated, len(counts) / n, counts.most_common(1)[0][1] / n, capitals, symbols, bars, bangs, digits,
        min(1.0, len(text) / n / 20), long, np.log1p(n) / 10, junk / n, min(1.0, worst), same, 0.0,
    ]


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t) for t in cells(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.float64()))],
            ["doc_id", "host", "path", "x"],
        )


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: centre, scale and weights, the constant first."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    weights = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        ridge = np.full(len(weights), PENALTY * len(x))
        ridge[0] = 1e-6
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(ridge), z.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, weights


def _log_odds(p: Column) -> Column:
    return F.log(p) - F.log(F.lit(1.0) - p)


def _chance(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _evidence(x: Column, model) -> Column:
    """Log-likelihood ratio of good to bad: the classifier's log-odds without those of its training rows."""
    centre, scale, weights, base = model
    total = F.lit(float(weights[0] - base))
    for j in range(len(centre)):
        total = total + (x[j] - float(centre[j])) / float(scale[j]) * float(weights[j + 1])
    words = F.expm1(x[MEASURES.index("log_words")] * 10)
    total = F.when(x[MEASURES.index("empty")] > 0, total).otherwise(total * words / (words + FEW_WORDS))
    return F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), total))


def _strength(groups: DataFrame, rate: str, above: str) -> float:
    """Beta strength of rates around the rate above, by moments over groups; 1 to 10,000."""
    expected = F.col(above) * (1 - F.col(above))
    row = (
        groups.filter("n > 1")
        .agg(
            F.sum(F.col("n") * F.pow(F.col(rate) - F.col(above), 2)).alias("spread"),
            F.sum(expected).alias("chance"),
            F.sum((F.col("n") - 1) * expected).alias("room"),
        )
        .first()
    )
    if not row["room"]:
        return 10.0
    correlation = (row["spread"] - row["chance"]) / row["room"]
    return float(min(10_000.0, max(1.0, 1 / correlation - 1))) if correlation > 0 else 10_000.0


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, evidence, host_rate, path_rate, quality, kept.

    ``labels`` (doc_id, quality 0 or 1); a document with several labels counts as each, null labels are left
    out. The classifier is fitted on at most ``TRAINED_ON`` labelled documents; without any label of
    either kind, evidence is 0 and nothing is rejected on it. Rates count every document but the row's own. Null text counts
    as empty, null host and path as sites of their own; a null doc_id has no label. Repeated rows come
    back as often as they came. Texts of any length are measured whole. Other columns, whatever their names, are
    not read. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    named = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    measured = written(
        named.mapInArrow(freed(_measured), "doc_id bigint, host string, path string, x array<double>"), "measures"
    )
    marks = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("y is not null")
    marked = measured.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("order"))
    # a cut by hash that few more than TRAINED_ON rows pass, so that no task sends the driver more than its share
    share = min(1.0, 1.02 * TRAINED_ON / max(1, marked.count()))
    sample = sorted(marked.filter(F.col("order") < int(share * (1 << 32))).collect(), key=lambda r: (r["order"], r["y"]))[:TRAINED_ON]
    y = np.array([r["y"] for r in sample])
    if len(y) and 0 < y.mean() < 1:
        x = np.array([r["x"] for r in sample])
        model = (*fitted(x, y), float(np.log(y.mean() / (1 - y.mean()))))
        evidence, start = _evidence(F.col("x"), model), float(y.mean())
    else:
        evidence, start = F.lit(0.0), 0.9
    scored = measured.select("doc_id", "host", "path", evidence.alias("evidence"))
    chance = _chance(F.col("evidence") + float(np.log(start / (1 - start))))
    sites = written(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")), "sites"
    )
    total = sites.agg(F.sum("good") / F.sum("n")).first()[0]
    top = min(0.999, max(0.001, total if total is not None else start))
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = hosts.withColumns({"rate": F.col("good") / F.col("n"), "above": F.lit(top)})
    of_host = _strength(hosts, "rate", "above")
    hosts = hosts.select(
        F.col("host").alias("h"),
        F.col("n").alias("host_n"),
        F.col("good").alias("host_good"),
        ((F.col("good") + of_host * top) / (F.col("n") + of_host)).alias("host_rate"),
    )
    paths = sites.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("rate", F.col("good") / F.col("n"))
    of_path = _strength(paths, "rate", "host_rate")
    paths = written(
        paths.select(
            F.col("host").alias("h"), F.col("path").alias("p"), "host_n", "host_good", F.col("n").alias("path_n"), F.col("good").alias("path_good")
        ),
        "paths",
    )
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    # a document's own evidence is added below: its sites' rates are those of the other documents
    posterior = _chance(F.col("evidence") + _log_odds(F.col("path_rate")))
    return (
        scored.withColumn("own", chance)
        .join(paths, same)
        .withColumn("host_rate", _rate_without("host", F.lit(top), of_host))
        .withColumn("path_rate", _rate_without("path", F.col("host_rate"), of_path))
        .withColumn("quality", posterior)
        .select(
            "doc_id", "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= KEEP_FROM).alias("kept")
        )
    )


def _rate_without(site: str, above: Column, strength: float) -> Column:
    """A site's posterior rate from the documents beside this one, shrunk toward the rate above."""
    good = F.greatest(F.col(f"{site}_good") - F.col("own"), F.lit(0.0))
    return (good + strength * above) / (F.col(f"{site}_n") - 1 + strength)


def kept_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A row goes only if its doc_id is rejected; of rows that share one, all go if one is. Rows without doc_id stay.
    """
    rejected = quality(docs, labels, host, path).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(small(written(rejected, "rejected")), "doc_id", "left_anti")
