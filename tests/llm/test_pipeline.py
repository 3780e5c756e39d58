"""The stages one after another on the smallest tables, and each on odd rows against plain versions."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from fathomry.llm import common, langid, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.documents(spark, sf)
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(spark, stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
        if name == "simhash_near_dedup":
            assert simhash.near_groups(spark, docs).where("doc_id <> component_id").count() == 0
    assert docs.count() > seen / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def text(rnd, n=80):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns named like those within."""
    rnd = random.Random(11)
    a, b, c = (text(rnd) for _ in range(3))
    rows = [(i, text(rnd), "en", "s") for i in range(30)]
    rows += [(30, a, "en", "s"), (30, a, "en", "s"), (31, a, None, "s"), (None, b, "en", None), (None, b, "en", None), (32, b, "en", "s"), (None, c, None, None)]
    rows += [(33, None, "en", "s"), (34, "", "en", "s"), (35, " \n\t", None, None), (36, "12 34 .. 56", "en", "s"), (37, text(rnd, 30000), "en", "s"), (37, text(rnd), "en", "s")]
    rows += [(38, f"{text(rnd)}\n\n{c}\n\n{text(rnd)}", "en", "s"), (39, f"# h\n\n  {text(rnd, 20)}\n\n{c}\n\n\tlast  words", "en", "s"), (40, "the same five words again " * 60, "en", "s")]
    return rows


EXTRA = ["row", "row_", "n", "order", "id_", "at_", "kept", "n_words", "component_id", "lang_pred", "score", "rejected", "fingerprint", "root", "margin"]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[f"{c}!" for c in EXTRA]) for r in rows], schema).repartition(4)


def rows_of(spark, name, docs):
    out = common.staged(spark, STAGES[name](spark, docs, ""), name)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == f"{c}!" for r in got for c in EXTRA)
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in got)
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in got)


def test_language_id(spark, odd):
    docs = frame(spark, odd)
    contents = langid.dictionaries(docs.where(~langid.held_out()))
    classify = langid.Classifier(contents)
    want = Counter(r for r in odd if classify(r[1])[2] >= langid.MARGIN)
    assert rows_of(spark, "language_id", docs) == want
    assert not any(i in (33, 34, 35, 36) for i, *_ in want) and want[(30, odd[30][1], "en", "s")] == 2


def test_quality_rules(spark, odd):
    docs = frame(spark, odd)
    verdict = {(r["doc_id"], r["lang"], r["source"], r["n_words"]): r["kept"] for r in quality.judged(docs).collect()}
    want = Counter(r for r in odd if verdict[(r[0], r[2], r[3], len(WORD.findall(r[1] or "")))])
    assert rows_of(spark, "quality_rules", docs) == want
    assert (40, odd[-1][1], "en", "s") not in want and want[(None, odd[33][1], "en", None)] == 2


def print_of(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_dedup(spark, odd):
    rows = [r for r in odd if len(r[1] or "") < 50000]
    prints = [print_of(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    best = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0)
        best.setdefault(group[i], []).append((rank, r))
    got = rows_of(spark, "simhash_near_dedup", frame(spark, rows))
    assert got.total() == len(best) and all(n == 1 for n in got.values())
    for members in best.values():  # one row, with the smallest doc_id; of equal ones any
        low = min(rank for rank, _ in members)
        assert sum(got[r] > 0 for r in {r for rank, r in members if rank == low}) == 1


def test_substring_dedup(spark, odd):
    docs = frame(spark, odd)
    first = {}
    for i, t, *_ in odd:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    want = Counter()
    for i, t, *rest in odd:
        spans = list(WORD.finditer(t or ""))
        w = [m.group() for m in spans]
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if gone and len(gone) == len(w):
            continue
        if gone:
            ends = [m.start() for m in spans[1:]] + [len(t)]
            cut = t[: spans[0].start()] + "".join(t[m.start() : e] for j, (m, e) in enumerate(zip(spans, ends)) if j not in gone)
            t = cut.rstrip(" \t\n\x0b\x0c\r") if len(w) - 1 in gone else cut
        want[(i, t, *rest)] += 1
    assert rows_of(spark, "substring_dedup", docs) == want
    assert any(i == 39 and t.startswith("# h\n\n  ") and t.endswith("\n\nlast  words") for i, t, *_ in want)


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.tokenizer_file("byte_bpe_50k.json"))
    got = STAGES["best_fit_packing"](spark, frame(spark, odd), "").collect()
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in odd]
    want = Counter()
    for r, x in zip(odd, ids):
        head = (len(x) - 1) % 2048 + 1
        for k, at in enumerate([0, *range(head, len(x), 2048)]):
            part = x[at : head if k == 0 else at + 2048]
            want[(r[0], k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= sum(map(len, ids)) / 2048 * 1.05 + 1


def test_empty_table(spark, odd):
    docs = frame(spark, odd).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(spark, stage(spark, docs, ""), name)
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = out
