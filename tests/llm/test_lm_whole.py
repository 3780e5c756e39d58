"""The model against a plain one with the same levels of exact counts; what its probabilities add up to."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fathomry.llm import lm


class Plain:
    """Counts in dictionaries, levels by a loop."""

    def __init__(self, texts):
        self.c = [Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
        self.total, self.distinct = sum(self.c[0].values()), len(self.c[0])

    def bounds(self, *gram):
        c, low = self.c[len(gram) - 1][gram], 1
        if not c:
            return 0, 0
        while (above := max(low + 1, low * 3 // 2)) <= c:
            low = above
        return low, above - 1

    def p(self, before, w):
        p = (self.bounds(w)[0] + 1) / (self.total + self.distinct + 1)
        for n, mu in ((1, 4.0), (2, 1.0)):
            context = before[len(before) - n :] if len(before) >= n else None
            if context and (high := self.bounds(*context)[1]):
                p = (self.bounds(*context, w)[0] + mu * p) / (high * (1 + 2**-20) + self.distinct * 2**-20 + mu)
        return p

    def score(self, t):
        return sum(math.log10(self.p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t))


def words(text):
    return [*(text or "").lower().split(), None]


@pytest.mark.parametrize("held, bucket", [(3 << 20, 4 << 20), (500, 1500), (300, 4)])
def test_score_equals_the_plain_model(spark, monkeypatch, held, bucket):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    rnd = random.Random(2)
    rows = [" ".join(f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(40)) for _ in range(150)]
    rows += rows[:5] + [None, "", "The Only one"]
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([words(t) for i, t in enumerate(rows) if not held_out(i)])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(spark, docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert math.isclose(got[i], model.score(words(t)), rel_tol=1e-9), i


def test_probabilities_add_up_to_one_at_most():
    # a context of seven whose successors came 4, 2 and 1 times, and contexts of any other counts
    rnd = random.Random(5)
    texts = [["v", w] for w in "aaaabbc"] + [[rnd.choice("pqr"), rnd.choice("xyz"), rnd.choice("stuvwxyz")] for _ in range(rnd.randint(50, 300))]
    model = Plain(texts)
    vocabulary = [w for (w,) in model.c[0]]
    for before in [(), ("v",), *[(u, v) for u in "pqr" for v in "xyz"], ("x",), ("nowhere",)]:
        assert 0 < sum(model.p(before, w) for w in vocabulary) + model.p(before, "unknown") <= 1 + 1e-12


def test_levels_and_the_filter():
    assert lm.LOWEST[:9].tolist() == [1, 2, 3, 4, 6, 9, 13, 19, 28]
    counts = np.arange(5000)
    levels = lm.level_of(counts)
    assert (lm.low_of(levels) <= counts).all() and (counts <= lm.high_of(levels)).all()
    rng = np.random.default_rng(0)
    keys, other = rng.integers(0, 2**63, 20000).astype(np.uint64), rng.integers(0, 2**63, 20000).astype(np.uint64)
    levels = rng.integers(1, 9, 20000)
    model = lm.Filter(int(levels.sum()))
    model.insert((keys, levels))
    assert np.unpackbits(model.bytes).sum() <= (lm.FILL + 0.01) * model.bits and len(lm.Filter(1).bytes) == 1024
    assert (model.levels(keys) == levels).all() and not model.levels(other).any()


def test_texts_that_came_twice_score_higher(spark, monkeypatch):
    rnd = random.Random(7)
    text = lambda: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    monkeypatch.setattr(lm, "held_out", lambda: lm.F.lit(False))
    once, twice = [text() for _ in range(60)], [text() for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(once + twice + twice)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(spark, docs).collect()}
    assert min(got[i] for i in range(60, 100)) > sorted(got[i] for i in range(60))[54]
