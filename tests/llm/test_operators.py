"""The other training-data operators against plain versions."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomry.llm import bpe, embed_dedup, langid, license_scan, packing, quality, queries, simhash, token_io

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "a <|endoftext|> b<|endoftext|>", " \n\t", "a", "'ll 're''s x'S", "a" * 3000, "日本語 テスト " * 50, "\x00 \x00a", "é’s    b\n\n", "x́ 1²3 ½", "the of and in to " * 30, "the of and in to " * 30]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé'ST") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    return ODD + [rnd.choice([" ", "\n", "  "]).join(rnd.choices(words, k=rnd.randint(0, 700))) for _ in range(60)]


def test_bpe_equals_the_library(spark, texts):
    import tiktoken
    from public_tokenizers import PATTERN

    path = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Ranks(path).ranks, special_tokens={})
    encoded = bpe.encode_documents(frame(spark, texts), path)
    for r in encoded.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert sum(r["piece_ids"]) == len(r["ids"]) and (r["piece_start"] or [0])[0] == 0
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_documents(encoded.drop("piece_start", "piece_ids"), path).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_decoding_slices_keep_every_row():
    ids = pa.array([[1, 2], None, [], [3] * 9, [4], [5, 6]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), ids], names=["doc_id", "ids"])
    for limit in (1, 3, 100):
        parts = list(bpe.id_slices([batch, batch.slice(0, 0), batch.slice(2)], 1, limit))
        assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() + batch.to_pylist()[2:]
        assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= limit for p in parts)


def test_pieces_equal_the_pattern():
    import regex
    from public_tokenizers import PATTERN

    from fathomry.llm import pretokenize

    pattern, rnd = regex.compile(PATTERN), random.Random(1)
    alphabet = [*"   \n\t ''''stmdrvelxé12!?.-日", "'s", "'re", "'ll"]
    for _ in range(800):
        rows = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(5)]
        raw = [r.encode() for r in rows]
        ends = np.cumsum([0, *map(len, raw)])
        got = pretokenize.piece_starts(np.frombuffer(b"".join(raw), np.uint8), ends).tolist()
        assert got == [e + len(r[: m.start()].encode()) for e, r in zip(ends, rows) for m in pattern.finditer(r)]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


def test_added_tokens_are_cut_out():
    tokenizer = token_io.tokenizer_of(queries.tokenizer_file("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["", end, f"a {end} b", f"{end}{end}x's", f" é{end}\n\n{end} ", "<|endof", "text|>", f"x <|endoftext{end}", "", f"'{end}s 12"]
    for rows in (texts, texts[:1], texts[1:2], texts[::-1]):
        raw = [t.encode() for t in rows]
        ids, offsets = tokenizer.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() + [0] for a, b in zip(offsets[:-1], offsets[1:])] == [library_ids(t) for t in rows]


def test_every_code_point_is_cut_like_the_library():
    tokenizer = token_io.tokenizer_of(queries.tokenizer_file("byte_bpe_50k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}" for c in points[i : i + 997]) for i in range(0, len(points), 997)]
    raw = [t.encode() for t in texts]
    ids, offsets = tokenizer.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library_ids(t)[:-1], i


def test_token_files(spark, texts, monkeypatch):
    monkeypatch.setattr(token_io, "BLOCK_IDS", 500)
    got = token_io.token_files(spark, frame(spark, texts), queries.tokenizer_file("byte_bpe_50k.json")).orderBy("doc_id").collect()
    before = 0
    for r, t in zip(got, texts, strict=True):
        ids = library_ids(t)
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (before, len(ids), np.array(ids, "<u4").tobytes())
        before += len(ids)


def test_control_bytes():
    rnd = random.Random(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = np.array([rnd.choice([rnd.randint(0, 255), rnd.randint(0, 65535), rnd.randint(0, 2**32 - 1)]) for _ in range(n)], np.uint32)
        assert (token_io.unpack(*token_io.pack(ranks), n) == ranks).all()


def test_packing(spark, texts):
    got = packing.pack_documents(spark, frame(spark, texts), queries.tokenizer_file("byte_bpe_50k.json"), 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids, pieces = library_ids(t), sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == 64 or k == 0 and r["length"] <= 64
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_near_the_bound(seed):
    rnd = random.Random(seed)
    lengths = Counter(min(2048, max(1, int(rnd.lognormvariate(6, 1.1)))) for _ in range(rnd.choice([3, 400, 20000])))
    plan = packing.plan(lengths, 2048)
    assert plan.given == lengths
    total = sum(n * c for n, c in lengths.items())
    assert plan.sequences <= 1.02 * total / 2048 + 2
    assert packing.plan({}, 2048).sequences == 0


@pytest.mark.parametrize("list_size, width", [(256, 1), (2e-5, 3)])
def test_simhash(spark, texts, monkeypatch, list_size, width):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    monkeypatch.setattr(simhash, "LIST", list_size)
    monkeypatch.setattr(simhash.common, "HUB", 2 if width > 1 else 1000)  # copies and centres are hubs
    assert simhash.width_for(120) == width
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    near = [" ".join(rnd.choice(["q", w]) if rnd.random() < 0.01 else w for w in base) for _ in range(60)]
    every = texts + near

    def plain(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [plain(t) for t in every]
    low = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 4 and low[j] < low[i]:
                    low[i] = low[j]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(spark, frame(spark, every)).collect()}
    assert got == {i: (format(p, "016x"), low[i]) for i, p in enumerate(prints)}


def test_simhash_counts_shared_bytes():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    flips = np.zeros(4000, np.uint64)
    for _ in range(4):
        flips |= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    far = a ^ (np.uint64(0x0101010101) << rng.integers(0, 24, 4000).astype(np.uint64))  # five bits, in five or six bytes
    assert simhash.near(a, a ^ flips).all() and not simhash.near(a, far).any()
    # linked pairs meet under some key of every width, whatever the order of rarity
    order = rng.permutation(2048).reshape(8, 256)
    for width in (1, 2, 3, 4):
        both = simhash.posted_under(a, order, width) & simhash.posted_under(a ^ flips, order, width)
        equal = np.zeros(4000, np.int64)
        for p in range(8):
            equal |= ((a ^ a ^ flips) >> np.uint64(8 * p) & np.uint64(255) == 0).astype(np.int64) << p
        assert (np.bitwise_count(both & equal) >= width).all()


def test_simhash_without_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "x y z q"), (None, None), (9, "")]
    got = sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (None, 9), (9, 9)], key=str)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    monkeypatch.setattr(embed_dedup.common, "HUB", 2)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(centre + rng.standard_normal(16) * s).tolist() for s in rng.uniform(0, 0.3, 20)]
    rows += [rows[0], rows[0], rows[5], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1e-300] * 16, [1e300] * 16]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, n_links int").repartition(3)
    good = [i for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)]
    unit = {i: np.array(rows[i]) / np.abs(rows[i]).max() for i in good}
    links = {i: [j for j in good if j != i and unit[i] @ unit[j] / math.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= 0.95] for i in good}
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark, df).collect()}
    assert len(got) == len(rows)
    found, wanted = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert 0.9 * wanted <= found <= wanted
    for i in range(len(rows)):
        if i not in links:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        else:
            assert got[i]["n_links"] <= len(links[i])
    assert got[240]["component_id"] == 0 and got[240]["n_links"] >= 2


def test_embeddings_recall_near_the_threshold(spark):
    # pairs planted at cosine 0.951 to 0.965 among far vectors, and null and repeated ids
    rng = np.random.default_rng(7)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.965, (3000, 1))
    near = cos * a + np.sqrt(1 - cos**2) * b
    ids = [*range(6000), None, None, 9, 10000, 10001]
    rows = np.concatenate([a, near, a[:1], a[1:2], a[2:3], [np.eye(64)[0], np.eye(64)[0]]])
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in zip(ids, rows)], "vec_id long, embedding array<double>, table int, bucket string").repartition(4)
    got = embed_dedup.near_vectors(spark, df).collect()
    assert len(got) == len(ids)
    linked = {r["vec_id"]: r for r in got if r["vec_id"] is not None and 10 <= r["vec_id"] < 6000}
    assert sum(linked[3000 + i]["component_id"] == i for i in range(10, 3000)) >= 0.9 * 2990
    assert all(r["component_id"] in (i, i - 3000) and r["n_links"] <= 1 + (3000 <= i < 3003) for i, r in linked.items())
    assert sorted(r["component_id"] for r in got if r["vec_id"] is None) == [0, 1]
    assert [r["component_id"] for r in got if r["vec_id"] == 9 and not r["kept"]] == [2]
    assert {r["vec_id"]: (r["component_id"], r["n_links"]) for r in got if (r["vec_id"] or 0) >= 10000} == {10000: (10000, 1), 10001: (10000, 1)}


def test_quality_measures(spark, texts):
    def plain(text):
        t = text or ""
        w = WORD.findall(t)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)

    more = texts + ["# a | b\n# a | b\n\n# a | b <x>"]
    docs = frame(spark, more).withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise("en"), "source": F.lit("s"), "kept": F.lit(1)})
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(more):
        want = plain(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(spark, docs.union(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(-1).cast("long")}))).withColumn("h", langid.held_out())
    rows = got.select("doc_id", "lang", "lang_pred", "score", "h", "rejected").collect()
    held = [r for r in rows if r["h"] and r["doc_id"] >= 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] == -1)["lang_pred"] == "und"
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.05


def test_license_lines_and_texts(spark):
    L = license_scan
    whole = f"{L.MIT_GRANT} {L.MIT_NOTICE} {L.MIT_AS_IS}"
    rows = [
        (1, "x y z\nReleased under the MIT license!\nfoo"),
        (2, "intro\n\n" + L.MIT_GRANT.replace(", ", ",\n")),
        (3, None),
        (4, ""),
        (5, "the MIT"),
        (6, "Released under the MIT License.\nReleased under the MIT License."),
        (6, "Released under the MIT License."),
        (7, "Copyright 2024 X. Released under the MIT License. All rights reserved."),
        (8, f"MIT License\n\nCopyright (c) 2020 A\n\n{L.MIT_GRANT}\n\n{L.MIT_NOTICE}\n\n{L.MIT_AS_IS}\n"),
        (9, whole),
        (10, "# SPDX-License-Identifier: GPL-2.0-or-later\nint x;"),
        (11, "Distributed. " * 3000 + "\n" + f"{L.BSD_GRANT} {L.BSD_TWO} {L.BSD_AS_IS}"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(i, t, 1, "u", ["w"]) for i, t in rows], "doc_id long, text string, template int, unit string, words array<string>")
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in L.scan(spark, docs).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5, 6, 7)} == {1: ("MIT", 1), 2: ("MIT", 2), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: ("MIT", 1), 7: ("MIT", 1)}
    assert {i: got[i][0] for i in (8, 9, 10, 11, None)} == {8: "MIT", 9: "MIT", 10: "GPL-2.0-or-later", 11: "BSD-2-Clause", None: "CC-BY-NC-4.0"}


def test_license_ties_take_the_first(spark):
    notices = [("B", "one two three four"), ("A", "one two three four"), ("C", "one two three five")]
    docs = spark.createDataFrame([(1, "One, two: three four"), (2, "one two three")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], round(r["dice"], 6)) for r in license_scan.scan(spark, docs, notices).collect()}
    assert got == {1: ("B", 1.0), 2: ("B", 0.8)}


def test_license_anchors_are_in_every_match():
    rnd = random.Random(3)
    for _ in range(200):
        words = [rnd.choice("the of and alpha beta gamma delta epsilon zeta eta".split()) for _ in range(rnd.randint(2, 30))]
        any_of = set(license_scan.anchors([("x", " ".join(words))], 0.8))
        unit = [w for w in words if rnd.random() < 0.9]
        a, b = Counter(zip(words, words[1:])), Counter(zip(unit, unit[1:]))
        if (total := a.total() + b.total()) and 2 * (a & b).total() / total >= 0.8:
            assert any_of & set(unit)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    json_file = queries.tokenizer_file("byte_bpe_50k.json")
    assert simhash.near_groups(spark, empty).count() == 0
    assert packing.pack_documents(spark, empty, json_file).count() == 0
    assert token_io.token_files(spark, empty, json_file).count() == 0
    assert quality.judged(empty).count() == 0
    assert langid.identify(spark, empty).count() == 0
    assert license_scan.scan(spark, empty).count() == 0
    assert embed_dedup.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
