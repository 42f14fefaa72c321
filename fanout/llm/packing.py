"""Packing token sequences by shortest-pack-first over the length histogram.

Texts become token ids inside tasks; every document is cut into pieces of the pack size and one rest. Only
the histogram of piece lengths (at most as many bins as the pack size) is planned: lengths are placed
longest first, each into the emptiest kind of open pack that it fits, whole runs of equal packs at a time,
so the plan's size does not depend on the number of documents. Patterns go back to pieces by rank: the
r-th piece of a length takes the r-th slot of that length in the plan. Tasks number their own pieces of each
length, so a rank needs a sum over tasks and no sorting of pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanout.llm.shared import cells, importable, written

PACK = 2048
END = 1
CACHED_WORDS = 300_000
PUNCTUATION = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""  # apostrophes begin tokens such as 's
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
#: Bytes without a printable character of their own are counted on from 256 by byte-level tokenizers.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "within"]


class WordIds(dict):
    """Little-endian 32-bit ids by word, words being separated by ASCII white space; made at first sight.

    White space never gets ids and no token spans it, so a text's ids are those of its words in turn. The
    tokenizer also cuts between a letter or digit and the ASCII punctuation after it, so both are looked up apart.
    Lower-case words of Latin letters go to the tokenizer's model alone: normalising and splitting do no more to
    them than give each byte its character.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.apart: dict[str, bool] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            for old in list(islice(self, CACHED_WORDS // 2)):
                del self[old]
        stem = word.rstrip(PUNCTUATION)
        if len(stem) < len(word) and stem and b"<|" not in word and self._ends_apart(stem):
            ids = self[stem] + self[word[len(stem) :]]
        else:
            ids = array("I", self._encoded(word)).tobytes()
        self[word] = ids
        return ids

    def _ends_apart(self, stem: bytes) -> bool:
        """Whether a stem ends in a letter or digit that stays one when normalised: some end in a mark then."""
        if stem[-1] < 128:
            return stem[-1:].isalnum()
        last = stem[-4:].decode(errors="ignore")[-1:]
        if last not in self.apart:
            form = self.tokenizer.normalizer.normalize_str(last) if self.tokenizer.normalizer else last
            self.apart[last] = form[-1:].isalnum()
        return self.apart[last]

    def _encoded(self, word: bytes) -> list[int]:
        if word.isalpha() and word.isascii():
            letters = word.decode()
        else:
            low = word.decode(errors="replace").lower()
            if not _LATIN.fullmatch(low):
                return self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids
            letters = low.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]


_TOKENIZERS: dict[str, WordIds] = {}


def _pieces(path: str, pack: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordIds(path))
        end = END.to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), cells(batch.column(1)), strict=True):
                # the tokenizer lower-cases, too
                data = b"".join(map(ids.__getitem__, text.lower().split())) + end
                n = len(data) // 4
                for start in range(0, n, pack):
                    part = data[4 * start : 4 * (start + pack)]
                    length = len(part) // 4
                    out.append((doc_id, start, length, zlib.crc32(part), n, task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE_NAMES)

    return run


def patterns(histogram: dict[int, int], pack: int) -> list[tuple[int, list[int]]]:
    """(how many packs, their lengths longest first) for every pattern, shortest pack first.

    A length goes to the open packs with the most room that it fits; as many of them take one piece
    each as there are pieces, and pieces that no open pack has room for open new packs.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if room not in open_packs:
            open_packs[room] = []
            insort(rooms, room)
        open_packs[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = rooms[-1] if rooms else 0
            if room < length:
                # as many of one length as a pack holds, the last pack with what is left over
                each = min(pack // length, left)
                put(pack - each * length, left // each, (length,) * each)
                left -= left // each * each
                continue
            count, lengths = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            taken = min(count, left)
            if taken < count:
                put(room, count - taken, lengths)
            put(room - length, taken, (*lengths, length))
            left -= taken
    return [(count, list(lengths)) for room in rooms for count, lengths in open_packs[room]]


def slots(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the rank-th piece of a length has its place there.

    ``ranks`` consecutive pieces of the length go to as many consecutive sequences, at one offset.
    """
    out, given, sequence = [], {}, 0
    for count, lengths in plan:
        offset = 0
        for length in lengths:
            first = given.get(length, 0)
            out.append((length, first, count, sequence, offset))
            given[length] = first + count
            offset += length
        sequence += count
    return out


def _ranked(pieces: DataFrame) -> DataFrame:
    """Ranks from 0 within each length: pieces of earlier tasks, then the place in its own task."""
    counts = pieces.groupBy("length", "task").agg((F.max("within") + 1).alias("c"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("within"))


def _place(places: list[tuple]):
    """Adds the place of each (length, rank): the slot range that holds it, by binary search."""
    by_length: dict[int, list[tuple]] = {}
    for length, first, _, sequence, offset in places:
        by_length.setdefault(length, []).append((first, sequence, offset))
    tables = {k: [np.array(c, np.int64) for c in zip(*v, strict=True)] for k, v in by_length.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.nonzero(lengths == length)[0]
                first, sequences, offsets = tables[int(length)]
                at = np.searchsorted(first, ranks[rows], "right") - 1
                sequence[rows] = sequences[at] + ranks[rows] - first[at]
                offset[rows] = offsets[at]
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer: str, pack: int = PACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids without special tokens, then ``END``; null and empty texts have the end
    alone. Pieces of a document do not overlap and cover it. Sequences hold at most ``pack`` ids, with
    gapless offsets from 0. Repeated rows are documents of their own. Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, pack), PIECES + ", task bigint, within bigint")
    pieces = written(cut, "pieces")
    histogram = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect()}
    places = slots(patterns(histogram, pack))
    ranked = _ranked(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(_place(places), PIECES + ", sequence_id bigint, offset bigint")
