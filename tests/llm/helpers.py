"""Documents for the tests: random texts, and tables with nulls, repeats and clashing columns."""

import random

CLASHING = ["digest", "id", "key", "n", "row", "part", "component", "version", "host", "rank", "values", "c", "block"]


def words(rnd: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def edited(rnd: random.Random, source: list[str], changes: int) -> list[str]:
    out = list(source)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = f"x{rnd.randrange(10**6)}"
    return out


def documents(spark, texts, with_clashes=True):
    """Rows of (doc_id, text), in the columns of documents and some that operators use themselves."""
    extra = CLASHING if with_clashes else []
    rows = [
        (d, t, "en", f"src{i % 3}", len(t) if t is not None else None, *["clash"] * len(extra))
        for i, (d, t) in enumerate(texts)
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, columns + "".join(f", {c} string" for c in extra))


EDGES = [
    (None, "no id at all"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "Same text here"),
    (5, "Same text here"),
    (6, "sAME tEXT hERE"),
    (7, "Éa ÉA É"),
    (8, "long " * 30_000),
    (9, "x" * 50_000),
]
