"""Substring dedup against a brute-force version."""

import random
import re

import pytest

from fathomry.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    first = {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        if doc_id is None:
            continue
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if doc_id is not None and first[tuple(w[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    shared = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(20)) for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words.append(rnd.choice(shared) if rnd.random() < 0.5 else " ".join(rnd.choice("xyzé　") * rnd.randint(1, 12) for _ in range(rnd.randint(0, 12))))
        rows.append((i, rnd.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a " * 5000), (204, "a " * 40), (7, shared[0]), (7, shared[0]), (None, shared[1]), (205, shared[1] + "\x00 " + shared[1])]
    return rows


@pytest.mark.parametrize("batches", [1, 6])
def test_equals_brute_force(spark, rows, batches):
    names = ["n_words", "row", "id", "at", "hash", "row_", "id_", "text_hash", "bucket", "a b.c"]
    docs = spark.createDataFrame([(i, t, *["k"] * len(names)) for i, t in rows], ["doc_id", "text", *names]).repartition(5)
    cut = substring.dedup(spark, docs, 5, batches)
    assert cut.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept"]
    assert cut.where("row <> 'k' or id_ <> 'k' or `a b.c` <> 'k'").count() == 0
    got = cut.select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 5)


def test_many_buckets_and_small_sends(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET", 1)
    monkeypatch.setattr(substring, "HELD", 50)
    monkeypatch.setattr(substring, "MOST_HELD", 50)
    monkeypatch.setattr(substring, "MOST_BITS", 9)
    monkeypatch.setattr(substring, "MOST_FILES", 16)  # many buckets in one file
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.dedup(spark, docs, 5).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 5)


def test_words_made_to_collide_are_told_apart(spark):
    # both words have one fingerprint under an unkeyed mix of eight bytes at a time
    same = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "uWm9ZKHTpBzKaUwG " + same), (2, "abcdefgh<SizA4b; " + same)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.dedup(spark, docs).collect()] == [0, 0]


def test_an_index_opened_again_goes_on(spark, rows, tmp_path):
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    first, second = [r for r in rows if r[0] < 60], [r for r in rows if r[0] >= 60]
    first.sort()
    path = f"file://{tmp_path}/index"
    index = substring.FingerprintIndex.create(spark, path, 3, 5, max_runs=1)
    index.add(substring.keyed(spark.createDataFrame(first[:30], "doc_id long, text string")))
    index.add(substring.keyed(spark.createDataFrame(first[30:], "doc_id long, text string")))  # compacted
    index.close()
    index = substring.FingerprintIndex.open(spark.newSession(), path)
    assert len(index.runs) == 1
    index.spark = spark
    index.close()
    index = substring.FingerprintIndex.open(spark, path)
    index.add(substring.keyed(spark.createDataFrame(second, "doc_id long, text string")))
    marked = {r["doc_id"]: len(r["at"]) // 4 for r in index.marked().collect()}
    index.drop()
    windows = lambda t: [tuple(w[i : i + 5]) for w in [WORD.findall(t or "")] for i in range(len(w) - 4)]
    low = {}
    for i, t in rows:
        for w in windows(t):
            low[w] = min(low.get(w, i), i)
    assert marked == {i: n for i, t in rows if (n := sum(low[w] < i for w in windows(t)))}


def test_a_very_long_text_and_one_long_word(spark, monkeypatch):
    monkeypatch.setattr(substring.common, "CHUNK_BYTES", 1 << 12)
    long = " ".join(f"v{i % 5000}" for i in range(40000))
    rows = [(1, "v1 v2 v3"), (2, long), (3, "x" * 300_000), (4, "a b " + long[:4000]), (5, "x" * 300_000 + " y")]
    got = substring.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 5)


def test_layout_is_kept(spark):
    a = "one two three four five"
    rows = [(1, a), (2, f"# Head\n\n  x y\n{a}\n\n\tz  w"), (3, f" x\n\n{a} \n"), (4, " a\n b "), (5, a)]
    got = {r["doc_id"]: r["kept"] for r in substring.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, layout=True).collect()}
    assert got == {1: a, 2: "# Head\n\n  x y\nz  w", 3: " x", 4: " a\n b ", 5: ""}


def test_empty_table(spark):
    assert substring.dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_bucket_writes_two_files_a_batch(spark, tmp_path):
    # every document repeats the first, so each bucket finds windows of documents of every group
    text = " ".join(f"w{i}" for i in range(3000))
    index = substring.FingerprintIndex.create(spark, f"file://{tmp_path}/index", 5)
    for low in (0, 40):
        index.add(substring.keyed(spark.createDataFrame([(low + i, text) for i in range(40)], "doc_id long, text string").repartition(8)))
    files = list((tmp_path / "index" / "runs").rglob("*.parquet"))
    marked = {r["doc_id"]: len(r["at"]) // 4 for r in index.marked().collect()}
    index.drop()
    assert marked == {i: 2988 for i in range(1, 80)}
    assert len(files) <= 2 * 2 * 2**5
