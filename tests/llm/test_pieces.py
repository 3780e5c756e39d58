"""The cache of pieces: what comes again is merged once, whatever else passes through."""

import random
from collections import Counter

import numpy as np

from fathomry.llm import pretokenize


def encode(cache, texts):
    raw = [t.encode() for t in texts]
    ids, offsets, _, _ = cache.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))]))
    return [bytes(ids[a:b].astype(np.uint8)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_pieces_that_come_again_are_merged_once():
    merged = Counter()

    def merge(pieces):
        merged.update(pieces)
        return [list(p) for p in pieces]

    cache = pretokenize.PieceCache(merge, keep=2000)
    for turn in range(6):  # the cache is full after every second
        text = "".join(f" w{chr(97 + i % 26)}{'x' * (i // 26 % 9)}{chr(97 + i // 234)}" for i in range(500))
        text += "".join(f" {chr(97 + turn)}{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}z" for i in range(1000))
        assert encode(cache, [text]) == [text.encode()]
    assert set(merged.values()) == {1}


def test_any_pieces_and_any_size_of_the_cache():
    rnd = random.Random(3)
    words = ["a", "a\0", "\0", "\0\0", "b" * 16, "b" * 17, "c" * 300, "é" * 8, "é" * 9, "12345678", "1234567\0", " ", "\n\n "]
    words += ["".join(rnd.choice("abcdé 1'\0") for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    for keep in (0, 50, 1000, 1 << 18):
        cache = pretokenize.PieceCache(lambda pieces: [list(p) * (len(p) % 3 == 0) + list(p) for p in pieces], keep)
        plain = pretokenize.PieceCache(cache.merge)
        for _ in range(8):
            texts = ["".join(rnd.choices(words, k=rnd.randint(0, 400))) for _ in range(5)]
            # each text alone by a cache of its own
            assert encode(cache, texts) == [encode(pretokenize.PieceCache(cache.merge), [t])[0] for t in texts] == encode(plain, texts)
