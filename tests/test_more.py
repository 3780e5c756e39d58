"""What has no SQL against plain versions; limits, pages past the end, long chains."""

import random

import pytest
from pyspark.sql import functions as F

from fathomry.functions import chunking
from fathomry.functions import text as fx
from fathomry.functions.stemming import stem
from fathomry.operators import aggregates, graph, joins, lookup, ranking, resolution, vector
from fathomry.sources import readers, sinks


def test_page_past_the_end_is_empty(spark):
    s = spark.createDataFrame([(i, "p", i) for i in range(5)], "id long, path string, line int")
    assert [(r["id"], r["position"], r["total"]) for r in lookup.page(s, 2, 3).collect()] == [(3, 4, 5), (4, 5, 5)]
    assert lookup.page(s, 2, 5).count() == 0
    told = lambda limit, offset: tuple(lookup.page_total(s, limit, offset).first())
    assert (told(2, 1), told(2, 3), told(2, 50)) == ((5, 3), (5, None), (5, None))


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(50)]
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    e = spark.createDataFrame([(a, b, "Calls") for a, b in pairs], "src long, dst long, kind string")
    got = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert got == {x: c for x, c in low.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_chains_of_any_length_and_cycles(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "root")] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "other")]
    got = dict(map(tuple, joins.reexports(spark.createDataFrame(rows, "name string, refers_to string")).collect()))
    assert got == {f"n{i}": "root" for i in range(41)} | {"e": "other"}


def test_mentions(spark):
    d = spark.createDataFrame([(1, "x one two three four five y"), (2, "zone two three four fivesome"), (3, "short here"), (4, "short one two three four five"), (5, None)], "id long, text string")
    t = spark.createDataFrame([(7, "one two three four five"), (8, "short")], "target long, label string")
    assert sorted(map(tuple, joins.mentions(d, t).collect())) == [(1, 7), (2, 7), (3, 8)]


def test_asof_equals_a_loop(spark):
    rnd = random.Random(4)
    d = [(i, rnd.choice("ab"), rnd.randint(0, 20)) for i in range(40)]
    c = [(i, rnd.choice("abc"), rnd.randint(0, 20)) for i in range(60)]
    got = {r["call_id"]: (r["def_line"], r["target"]) for r in joins.asof_closest(spark.createDataFrame(c, "call_id long, k string, line int"), spark.createDataFrame(d, "id long, k string, line int"), "k").collect()}
    want = {i: max(((x, -j) for j, kk, x in d if kk == k and x <= line), default=None) for i, k, line in c}
    assert got == {i: (w[0], -w[1]) for i, w in want.items() if w}


def test_label_propagation_equals_a_plain_one(spark):
    rnd = random.Random(9)
    pairs = {(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(70)}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {x: x for x in near}
    for _ in range(20):
        votes = {x: [label[y] for y in near[x]] for x in near}
        label = {x: min(label[x], max(set(v), key=lambda y: (v.count(y), -y))) for x, v in votes.items()}
    e = spark.createDataFrame(list(pairs), "src long, dst long")
    assert {r["id"]: r["label"] for r in resolution.propagated(e).collect()} == label


def test_c3_orders(spark):
    assert resolution.c3(1, {1: [2, 3], 2: [4], 3: [4]}) == [1, 2, 3, 4]
    assert resolution.c3(1, {1: [2, 3], 2: [4, 5], 3: [5, 4]}) is None
    assert resolution.c3(1, {1: [2], 2: [1]}) is None
    p = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 4, 0)], "src long, dst long, position int")
    assert [r["ancestor"] for r in resolution.mro(p, 3).where("id = 1").orderBy("position").collect()] == [1, 2, 3, 4]


def test_local_targets(spark):
    cases = {"../a/b.md": ("docs/a/b.md", None), "x.md#top": ("docs/guide/x.md", "top"), "#here": ("docs/guide/index.md", "here"), "https://x/y": (None, None), "/abs": (None, None), "../../../out": (None, None), "./y/../z": ("docs/guide/z", None)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    path, fragment = fx.local_target(F.lit("docs/guide/index.md"), F.col("t"))
    assert {r["t"]: (r["p"], r["f"]) for r in df.select("t", path.alias("p"), fragment.alias("f")).collect()} == cases


def test_chunks_of_markdown(spark):
    text = "intro\n\n# A\n\nshort\n\nalso short\n\n## B\n\n" + "word " * 100 + "\n\n```\n# no heading\n```\n\n# C\nlast"
    chunks = chunking.chunks_of(text, least=30, most=200, overlap=20)
    assert [c[1] for c in chunks if "short" in c[2]] == [["A"]]
    assert {tuple(c[1]) for c in chunks if "word" in c[2]} == {("A", "B")} and chunks[-1][1] == ["C"]
    assert all(len(c[2]) <= 200 and text[c[0] :].lstrip("\n").startswith(c[2][:5]) for c in chunks)
    assert not any(c[1][-1:] == ["no heading"] for c in chunks)
    assert chunking.chunks_of("") == [] and chunking.chunks_of(" \n\n ") == []
    got = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), 30, 200, 20).collect()
    assert [(r["start"], r["headings"], r["content"]) for r in got] == chunks


def test_stems():
    assert [stem(w) for w in ("libraries", "classes", "running", "hopped", "indexed", "quickly", "bus", "this", "sing", "created")] == ["library", "class", "run", "hop", "index", "quick", "bus", "this", "sing", "create"]


def test_limits_raise(spark):
    files = spark.createDataFrame([("a", 5), ("b", 6)], "path string, bytes long")
    assert readers.snapshot(files, 2, 11).count() == 2
    for bad in ((1, 100), (5, 10)):
        with pytest.raises(ValueError):
            readers.snapshot(files, *bad)
    with pytest.raises(ValueError):
        ranking.within_budget(spark.range(3), 2)


def test_globs():
    import re

    match = lambda g, p: bool(re.search(readers.glob_pattern(g), p))
    assert match("**/*.md", "a/b/c.md") and match("**/*.md", "c.md") and not match("*.md", "a/c.md") and match("a?c", "abc") and not match("a?c", "a/c") and match("src/**", "src/x/y")


def test_generations_and_journal(spark):
    table = sinks.Generations(spark)
    table.publish(table.stage(spark.range(3)))
    table.stage(spark.range(9))
    assert sinks.Generations(spark, table.path).current().count() == 3
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    deltas = spark.createDataFrame([(1, "x", 1, False), (1, "y", 2, False), (2, None, 1, True), (3, "c", 1, False)], "id long, v string, seq int, deleted boolean")
    assert sorted(map(tuple, sinks.journal(base, deltas, "id").collect())) == [(1, "y"), (3, "c")]


def test_ivf_reads_one_cluster_and_assign_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    centres = spark.createDataFrame([(5, [0.0, 1.0]), (3, [1.0, 0.0])], "cluster int, c array<double>")
    got = {r["id"]: r["cluster"] for r in vector.assign(v, centres).collect()}
    assert got == {1: 3, 2: 5, 3: 3, 4: 3}
    with pytest.raises(Exception, match="more than 100"):
        vector.assign(v, spark.range(101).select(F.col("id").cast("int").alias("cluster"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("c"))).collect()


def test_stored_postings_score_like_texts(spark):
    rows = [(1, "red red widget", "a b"), (2, "Widget", "red"), (3, None, ""), (4, "other", "widget-widget")]
    t = spark.createDataFrame(rows, "id long, name string, path string")
    fields = {"name": "name", "path": "path"}
    got = {r["id"]: r["score"] for r in aggregates.bm25_of(aggregates.postings(t, "id", fields), aggregates.lengths(t, fields), ["red", "widget", "red"], {"name": 2.0, "path": 1.0}).collect()}
    import math

    words = {f: {r[0]: [w for w in (r[k] or "").lower().replace("-", " ").split()] for r in rows} for k, f in ((1, "name"), (2, "path"))}
    want = {}
    for f, boost in (("name", 2.0), ("path", 1.0)):
        sizes = [len(w) if rows[i][1 if f == "name" else 2] is not None else None for i, w in enumerate(words[f].values())]
        known = [s for s in sizes if s is not None]
        mean = sum(known) / len(known)
        for q in ("red", "widget"):
            df = sum(q in w for w in words[f].values())
            for i, w in words[f].items():
                if tf := w.count(q):
                    want[i] = want.get(i, 0) + boost * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bounded_bursts(spark):
    from fathomry.streaming import changes

    rows = [("a", 0), ("a", 5), ("a", 9), ("a", 14), ("a", 100), ("b", 3)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r["k"], r["first"].timestamp(), r["n"]) for r in changes.bounded_bursts(df, "k", 10, 8).collect())
    assert got == [("a", 0.0, 2), ("a", 9.0, 2), ("a", 100.0, 1), ("b", 3.0, 1)]
