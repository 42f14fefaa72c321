"""Quality rules, lines first: lines that fail a rule go, then documents that lose too much text.

Words are runs of characters other than ASCII white space, lines are parted by ``\\n``. A line with a word fails

* as navigation, when stand-alone separators are two or more and a fifth of its words,
* as boilerplate, when it is short and holds a phrase of notices and licences, whatever its case in ASCII,
* for its punctuation, when no word of it ends a sentence, or over three in ten end in a run of marks.

The first of these counts. Lines without a word pass and weigh nothing. A document stays when its whole text
passes the counts of the base (words enough, few of them in repeated runs) and its failed lines
hold at most three tenths of its word characters.

Every text is measured alone, one at a time, where its row stands: nothing is shuffled, and a task holds one batch
and some arrays over the words of one text, however long that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from fanout.llm.shared import cells, importable

SYMBOLS = "#*$%&|<>"

# fixed values: what the line rules look for
SEPARATORS = ["|", "»", "›", "•", "·", ">", "/"]
ENDS = r"[.!?…。！？][\"'”’»)\]]*$"
MARKS = r"[!?#*$%&|<>]{2,}$"
PHRASES = [
    "all rights reserved",
    "accept cookies",
    "back to top",
    "by using this site",
    "click here",
    "cookie policy",
    "enable javascript",
    "general public license",
    "is licensed under",
    "licensed under the",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up for",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
    "use of cookies",
    "uses cookies",
]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are whole percentages."""

    least_words: int = 10
    window: int = 5
    repeated: int = 20
    separators: int = 2
    separated: int = 20
    boilerplate_words: int = 40
    marked: int = 30
    lost: int = 30


MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_navigation_lines",
    "n_boilerplate_lines",
    "n_punctuation_lines",
    "lost_chars",
]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BEGINS = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)  # bytes that begin a character of a word
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _at_word_end(pattern: str) -> re.Pattern[bytes]:
    """The pattern, which ends in ``$``, at the end of a word inside a line; classes become alternatives of bytes."""
    spelled = re.sub(r"\[((?:\\.|[^\]\\])*)\]", lambda m: "(?:%s)" % "|".join(map(re.escape, _members(m[1]))), pattern)
    return re.compile(spelled.removesuffix("$").encode() + rb"(?=[\x20\x09-\x0D]|\Z)")


def _members(inside: str) -> list[str]:
    return list(inside.replace("\\", ""))


_ENDS, _MARKS = _at_word_end(ENDS), _at_word_end(MARKS)
_PHRASES = re.compile("|".join(map(re.escape, PHRASES)).encode(), re.IGNORECASE)
_SEPARATORS = {s.encode() for s in SEPARATORS}


def failed_rule(line: bytes, words: list[bytes], rules: Rules) -> int:
    """0 when a line passes, else 1 for navigation, 2 for boilerplate, 3 for punctuation."""
    n = len(words)
    apart = sum(w in _SEPARATORS for w in words)
    if apart >= rules.separators and 100 * apart >= rules.separated * n:
        return 1
    if n <= rules.boilerplate_words and _PHRASES.search(line):
        return 2
    if not _ENDS.search(line) or 100 * len(_MARKS.findall(line)) > rules.marked * n:
        return 3
    return 0


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs, equal for equal pairs alone."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, width: int) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    windows = ids[:n]
    for k in range(1, width):
        windows = _numbered(windows, ids[k : n + k])
    again = np.bincount(windows)[windows] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(ids) + 1, np.int64)
    covered[:n] += again
    covered[width:] -= again
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measured(text: bytes, rules: Rules) -> tuple[list[int], list[bytes]]:
    """The measures of a whole text, in MEASURES' order, and the lines that pass."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    seen: set[bytes] = set()
    passing, failed, lost, doubled = [], [0, 0, 0, 0], 0, 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            ids.extend([number.setdefault(w, len(number)) for w in words])
            doubled += line in seen
            seen.add(line)
            rule = failed_rule(line, words, rules)
            if rule:
                failed[rule] += 1
                lost += int(_BEGINS[np.frombuffer(line, np.uint8)].sum())
                continue
        passing.append(line)
    data = np.frombuffer(text, np.uint8)
    numbers = [
        len(ids),
        int(_BEGINS[data].sum()),
        int(_SYMBOL[data].sum()),
        doubled,
        repeated_words(np.array(ids, np.int64), rules.window),
        *failed[1:],
        lost,
    ]
    return numbers, passing


def _fails(column, rules: Rules):
    """Whether the base fails, and whether too much text is lost, from the measures."""
    few = column("n_words") < rules.least_words
    base = few | (100 * column("n_repeat_words") > rules.repeated * column("n_words"))
    return base, 100 * column("lost_chars") > rules.lost * column("word_chars")


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of MEASURES, base_failed and kept.

    Null text has no words and so fails the base. Repeated rows and ids, null ids and ties are measured row by row;
    other columns, whatever their names, are not read; an empty table gives no rows; texts of any length are
    measured whole.
    """
    importable(docs.sparkSession)
    source = docs.select("doc_id", "text")
    schema = StructType([source.schema["doc_id"]])
    for name in MEASURES:
        schema = schema.add(name, LongType())

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(text, rules)[0] for text in cells(batch.column(1))]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])

    base, much = _fails(F.col, rules)
    return source.mapInArrow(counted, schema).withColumns({"base_failed": base, "kept": ~(base | much)})


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that stay, in their own columns, their texts without the lines that fail.

    ``n_chars``, where there is such a column, becomes the new text's length. Nulls, repeats and extra columns as
    in ``verdicts``; texts are cleaned whole, one at a time.
    """
    importable(docs.sparkSession)
    place = docs.columns.index("text")

    def stripped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay, texts = [], []
            for text in cells(batch.column(place)):
                numbers, lines = measured(text, rules)
                base, much = _fails(dict(zip(MEASURES, numbers, strict=True)).__getitem__, rules)
                stay.append(not (base or much))
                texts.append(b"\n".join(lines).decode() if stay[-1] else None)
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(stay, pa.bool_()))

    out = docs.mapInArrow(stripped, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
