"""The base score against a plain count, and the model's probabilities."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from fathomry.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    tokens = lambda t: [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n = sum(c.values())
    return {(i, t): (held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("held, bucket", [(3 << 20, 4 << 20), (500, 200)])
def test_base_score(spark, monkeypatch, held, bucket):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["A", "b", "É", "the", "The", "x" * 30, str(rnd.randint(0, 99))]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (3, "the b"), (3, "the b"), (None, "the é b"), (503, "z" * 10000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, bucket string").repartition(3)
    want = brute(rows)
    got = lm.score(spark, docs).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for r in got:
        match = [k for k, v in want.items() if k[0] == r["doc_id"] and v[1] == r["n_tokens"] and abs(v[4] - r["base_score"]) < 1e-9 * max(1, -v[4])]
        assert match, r
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[match[0]][:4]
        assert r["score"] < 0
        seen[match[0]] += 1
    assert seen == Counter(rows)


def test_empty_table(spark):
    assert lm.score(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
