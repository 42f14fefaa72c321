"""Packing against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fanout.llm import packing
from helpers import EDGES, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    (30, "Don't stop; it's <|endoftext|> the 'end'... of §§2.5—“quotes”, été ΑΣ. ΟΔΟΣ, İstanbul ＦＵＬＬ １２３ ½"),
    (31, "a b c\x1cd\x85e \x0b\x0c\r\n,,, ... a,b.c;d 3rd 5% $100,000.00 C++ x_y __init__ #tag @you http://a.b/c?d=e&f"),
    (32, "’s 's 'S 't're 've 'm'll'd »word». «x» 你好，世界。 नमस्ते 🙂🙂 👨‍👩‍👧 café"),
]


def test_pieces_cover_what_the_tokenizer_gives(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    texts = EDGES + ODD + [(100 + i, " ".join(rnd.choice(["the,", "Ble", "tion.", "x" * 9, "ça!?"]) for _ in range(rnd.randrange(3000)))) for i in range(40)]
    got = packing.packed(documents(spark, texts), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[(d, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(documents(spark, []), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_place_every_length_once(histogram):
    plan = packing.patterns(histogram, 64)
    placed = Counter()
    for count, lengths in plan:
        assert count > 0 and sum(lengths) <= 64
        for length in lengths:
            placed[length] += count
    assert placed == Counter(histogram)
    # a plan grows with the number of lengths, not of documents
    assert len(packing.patterns({k: v * 1000 for k, v in histogram.items()}, 64)) <= 64 * 40


def test_slots_give_every_rank_one_place():
    histogram = {7: 10, 3: 25, 2: 4}
    taken = set()
    for length, first, count, sequence, offset in packing.slots(packing.patterns(histogram, 10)):
        for i in range(count):
            taken.add((length, first + i, sequence + i, offset))
    assert Counter(t[0] for t in taken) == Counter(histogram)
    assert {(t[0], t[1]) for t in taken} == {(k, r) for k, n in histogram.items() for r in range(n)}


def test_words_before_punctuation_get_the_tokenizers_ids():
    """Letters that end in a mark once normalised, among them every letter of some scripts, and random strings."""
    from tokenizers import Tokenizer

    rnd, alphabet = random.Random(5), "aéİIıßŒǅTÜRKİ.,!?-'\"()0９²ºªДя中\u0307\u0301"
    strings = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 9))) for _ in range(8000)]
    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x900, 0xA00), *range(0xFB00, 0xFB50)]]
    strings += ["TÜRKİ.", "İ,", *(c + p for c in letters if c.isalnum() for p in (".", "',"))]
    ids, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for text, want in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True):
        got = b"".join(map(ids.__getitem__, text.encode().lower().split()))
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
