"""What the language model leaves on disk: no copy beside its two shuffles, and fingerprints that take what they must, once."""

import secrets
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from fathomry.llm import common, lm


def test_nothing_is_staged(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 500)
    monkeypatch.setattr(lm, "BUCKET", 200)
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    files = lambda: {str(p) for p in shared.rglob("*")}
    before = files()
    docs = spark.createDataFrame([(i, f"a b {i} the {i % 7}") for i in range(300)], "doc_id long, text string").repartition(3)
    scored = lm.score(spark, docs)
    assert {r["doc_id"] for r in scored.collect()} == set(range(300))
    assert {r["train_tokens"] for r in scored.collect()} == {scored.where("not held_out").agg({"n_tokens": "sum"}).first()[0]}
    assert files() == before


@pytest.mark.parametrize("bits", [0, 3])
def test_a_chunk_sends_fingerprints_once_and_tightly(bits):
    n = 40_000
    counts = lm._Counts(bits, secrets.token_bytes(32))
    counts.add(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(map(str, range(n)))]), pa.array([False])], names=["id", "text", "held_out"]))
    rows = [r for batch in counts.send(0) for r in batch.to_pylist()]
    size = lambda c: sum(len(r[c] or b"") for r in rows)
    for g, width in (("words", 64), ("bigrams", 48), ("trigrams", 48)):
        # n numbers evenly spread below 2**width take width - log2(n) + 1.44 bits each
        assert size(g) <= n * (width - np.log2(n) + 1.44 + 0.2) / 8 + 20 * len(rows), g
    assert sum(size(c) for c in lm.HEAD) <= 1.05 * n * 2 + 1000, "ranks of 16 bits"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 1000])
@pytest.mark.parametrize("top", [8, 21, 41, 48, 64])
def test_sorted_numbers_come_back(n, top):
    rng = np.random.default_rng(n + top)
    values = np.unique(rng.integers(0, 2**top - 1, n, dtype=np.uint64, endpoint=True))
    for v in (values, np.unique(np.concatenate([values, np.array([0, 2**64 - 1], np.uint64)]))):
        got = lm.unpack_sorted(lm.pack_sorted(v))
        assert got.dtype == np.uint64 and got.tolist() == v.tolist()
