"""SentencePiece encoding and decoding: an Aho-Corasick automaton finds the pieces of a text.

The pieces and scores come from a public model file. The automaton reads a text once; at each position its
output links list the pieces that end there. In a unigram model each relaxes the best score of a segmentation
up to that position (Viterbi). In a BPE model scores are merge ranks, whose sums mean nothing: there the
first of them, longest first, that may stand behind the piece before it is the best. Characters in no piece fall back to
their UTF-8 bytes. White space separates words in the
model (a mark in front of each), and no piece spans the end of a word: so the pass runs once per distinct
word of a task, and texts are the joined results of their words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fanout.llm.shared import cells, importable

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
CACHED_WORDS = 800_000
CACHED_PAIRS = 400_000
NOTHING = -(1 << 21)  # before a word's first piece
BYTE_SCORE = -1e6  # a byte costs more than any pieces could
OUT = "doc_id bigint, n_pieces bigint, n_bytes bigint, ids binary, decoded string, restored boolean"


class Pieces(dict):
    """Little-endian 32-bit ids by word, the word with its mark; made by Viterbi at first sight: for unigram models."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.older: dict[str, bytes] = {}
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[bytes] = []
        self.byte_id = [0] * 256
        self.automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.pieces.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.pieces.append(b"")
            else:
                self.pieces.append(piece.encode())
                self.automaton.add_word(piece, (i, len(piece), model.get_score(i)))
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} spans words")
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> bytes:
        """Words met since the last half of the cache was filled are kept, others are forgotten and made again."""
        if len(self) >= CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.segmented(word)).tobytes()
        self[word] = ids
        return ids

    def segmented(self, word: str) -> list[int]:
        return self.viterbi(word)

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best-scoring segmentation; of equal scores the one whose last piece is longest."""
        n = len(word)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 1
        for end, (i, length, score) in self.automaton.iter(word):
            while at <= end:  # positions before this end are final
                if best[at] <= BYTE_SCORE / 2:  # else no path with a byte is better
                    self._by_bytes(word, at, best, back)
                at += 1
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1] or (total == best[end + 1] and start < back[end + 1][0]):
                best[end + 1], back[end + 1] = total, (start, i)
        while at <= n:
            if best[at] <= BYTE_SCORE / 2:
                self._by_bytes(word, at, best, back)
            at += 1
        ids: list[int] = []
        while n:
            start, i = back[n]
            ids.extend([i] if i >= 0 else [self.byte_id[b] for b in reversed(word[start:n].encode())])
            n = start
        return ids[::-1]

    def _by_bytes(self, word: str, at: int, best: list[float], back: list[tuple[int, int]]) -> None:
        total = best[at - 1] + BYTE_SCORE * len(word[at - 1].encode())
        if total > best[at]:
            best[at], back[at] = total, (at - 1, -1)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: marks for its spaces, one in front, and its words with the marks before them."""
        words = _WORDS.findall((" " + text).replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a run of ids: pieces and bytes joined, marks as spaces, without the one in front."""
        text = b"".join(map(self.pieces.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Merges(Pieces):
    """The same for BPE models, whose scores are merge ranks: the best path is the one that merging by rank leaves.

    Pieces are such a path when each stands beside the next as it would if the two were merged alone. So in the one pass
    over a word, the piece at each position is the first of those ending there, longest first, that may stand behind
    the last piece of the text before it. Whether it may is found once for each pair of pieces, by merging the two.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.beside: dict[int, bool] = {}  # by the two numbers of a pair, put into one

    def segmented(self, word: str) -> list[int]:
        n, done, beside = len(word), 0, self.beside
        last = [NOTHING] * (n + 1)  # the piece before each position; below 0: a character in no piece
        back = [0] * (n + 1)
        for end, (i, length, _) in self.automaton.iter(word):
            if end < done:
                continue  # a longer piece ends there
            while done < end:
                if not self._alone(word, done, last, back):
                    return self._ids(word, self.merged(word))
                done += 1
            start = end + 1 - length
            fits = beside.get((last[start] << 32) + i)
            if fits is None:
                fits = self._may_stand(last[start], i)
            if fits:
                done = end + 1
                last[done], back[done] = i, start
        while done < n:
            if not self._alone(word, done, last, back):
                return self._ids(word, self.merged(word))
            done += 1
        ids: list[int] = []
        while n:
            i, start = last[n], back[n]
            ids.extend([i] if i >= 0 else [self.byte_id[b] for b in reversed(word[start:n].encode())])
            n = start
        return ids[::-1]

    def _alone(self, word: str, at: int, last: list[int], back: list[int]) -> bool:
        """A character that no piece explains stands for itself, if it may."""
        own = -1 - ord(word[at])
        if not self.beside.get((last[at] << 32) + own, False) and not self._may_stand(last[at], own):
            return False  # not seen so far: merging the whole word decides
        last[at + 1], back[at + 1] = own, at
        return True

    def _text(self, i: int) -> str:
        return self.pieces[i].decode() if i >= 0 else chr(-1 - i)

    def _may_stand(self, left: int, right: int) -> bool:
        """Whether merging both pieces' characters gives these two again; for a word's first piece, that piece."""
        if len(self.beside) >= CACHED_PAIRS:
            for old in list(islice(self.beside, CACHED_PAIRS // 2)):
                del self.beside[old]
        before = "" if left == NOTHING else self._text(left)
        fits = self.merged(before + self._text(right)) == ([0, len(before)] if before else [0])
        self.beside[(left << 32) + right] = fits
        return fits

    def _ids(self, word: str, starts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(word)], strict=True):
            i = self.automaton.get(word[a:b], None)
            out.extend([i[0]] if i else [self.byte_id[x] for x in word[a:b].encode()])
        return out

    def merged(self, word: str) -> list[int]:
        """Where the symbols begin that are left when neighbours merge, best rank first, of equal ranks the leftmost."""
        found = {(last + 1 - length, last + 1): -score for last, (_, length, score) in self.automaton.iter(word)}
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that begins at each place; 0: none does
        pairs = [(found[a, a + 2], a, a + 1, a + 2) for a in range(n - 1) if (a, a + 2) in found]
        heapify(pairs)
        while pairs:
            _, a, b, c = heappop(pairs)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if (a, end[c]) in found:
                    heappush(pairs, (found[a, end[c]], a, c, end[c]))
            if a and (before[a], c) in found:
                heappush(pairs, (found[before[a], c], before[a], a, c))
        return [a for a in range(n) if end[a]]


def model_of(path: str) -> Pieces:
    """The encoder for a model file's type."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    kinds = {proto.trainer_spec.UNIGRAM: Pieces, proto.trainer_spec.BPE: Merges}
    kind = proto.trainer_spec.model_type
    if kind not in kinds:
        raise ValueError(f"{path}: neither a unigram nor a BPE model")
    return kinds[kind](path)


_MODELS: dict[str, Pieces] = {}


def _coded(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(path) or _MODELS.setdefault(path, model_of(path))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, data in zip(batch.column(0).to_pylist(), cells(batch.column(1)), strict=True):
                text = data.decode(errors="replace")
                ids = model.encode(text) if text else np.empty(0, np.int32)
                back = model.decode(ids.tolist())
                out.append((doc_id, len(ids), len(data), ids.tobytes(), back, back.replace(MARK, " ") == text.replace(MARK, " ")))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_pieces", "n_bytes", "ids", "decoded", "restored"],
            )

    return run


def coded(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, n_bytes, ids (little-endian 32-bit), decoded, restored.

    ``decoded`` is made from the ids alone; ``restored`` says whether it is the text again (the model's mark
    itself, where a text has one, comes back as a space). Null text counts as empty and has no ids. A text's
    ids do not depend on other texts. Repeated rows come back as often as they came. Other columns are
    not read. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_coded(model), OUT)

