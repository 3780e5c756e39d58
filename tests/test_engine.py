"""Sources, sinks, streaming and limits on small inputs."""

import pytest
from pyspark.sql import functions as F

from fathomry.functions import text as fx
from fathomry.operators import aggregates, graph, joins, lookup
from fathomry.sources import readers
from fathomry.streaming import changes


def test_files_skip_hidden(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\n")
    (tmp_path / "a" / ".y.md").write_text("no")
    got = readers.files(spark, str(tmp_path), "*.md").collect()
    assert [r["content"] for r in got] == ["# T\n"] and len(got[0]["hash"]) == 64


def test_dump_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    readers.write_dump(s, e, str(tmp_path / "d"))
    s2, e2 = readers.read_dump(spark, str(tmp_path / "d"), "id long, name string", "src long, dst long")
    assert sorted(s2.collect(), key=str) == sorted(s.collect(), key=str) and e2.collect() == e.collect()


def test_transcripts_of_both_dialects(spark):
    lines = [
        '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"hi"}]}}',
        '{"type":"user","uuid":"u","sessionId":"s","message":{"role":"user","content":[{"type":"text","text":"yo"},{"type":"text","text":"there"}]}}',
        '{"type":"user","isMeta":true,"message":{"role":"user","content":[{"type":"text","text":"meta"}]}}',
        '{"type":"user","uuid":"v","message":{"role":"user","content":[{"type":"text","text":"yo"},{"type":"text","text":"there"}]}}',
        '{"broken',
    ]
    got = readers.transcripts(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(r["text"] for r in got) == ["hi", "yo\nthere"]


def test_manifests_and_operations(spark):
    m = spark.createDataFrame([("p", '{"name":"n","dependencies":{"a":"1"},"devDependencies":{"a":"0","b":"2"}}'), ("q", '{"name":"x"}')], "path string, content string")
    assert sorted(tuple(r) for r in readers.package_manifests(m).collect()) == [("p", "n", "a", "1"), ("p", "n", "b", "2")]
    o = spark.createDataFrame([("s", '{"paths":{"/x":{"get":{"operationId":"getX"},"post":{}}}}')], "path string, content string")
    assert sorted(r["operation"] for r in readers.api_operations(o).collect()) == ["getX", "post /x"]


def test_budgets_raise(spark):
    e = spark.createDataFrame([(i, i + 1, "Calls", 1) for i in range(20)], "src long, dst long, kind string, line int")
    assert graph.impact(e, 20, 5).count() == 5
    with pytest.raises(graph.BudgetExceeded):
        graph.impact(e, 20, 5, max_nodes=2)
    with pytest.raises(ValueError):
        graph.impact(e, 20, 11)
    with pytest.raises(ValueError):
        lookup.inventory(spark.range(5).selectExpr("id", "'p' path", "1 line"), F.lit(True), 3)
    with pytest.raises(ValueError):
        fx.in_prefix(F.col("path"), "../x")


def test_path_and_components(spark):
    e = spark.createDataFrame([(1, 2, "Calls"), (2, 3, "Calls"), (1, 4, "Uses"), (4, 3, "Uses"), (7, 8, "Uses"), (8, 1, "DispatchCandidate")], "src long, dst long, kind string")
    assert [r["id"] for r in graph.path(e, 1, 3).orderBy("position").collect()] == [1, 2, 3]
    assert graph.path(e, 3, 1).count() == 0
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}


def test_risk():
    assert [aggregates.risk(*x) for x in ((10, 0, 0), (0, 3, 0), (0, 1, 0), (3, 0, 0), (1, 0, 1))] == ["high", "high", "medium", "medium", "low"]


def test_ambiguous_resolves_nothing(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "call long, target string")
    assert [tuple(r) for r in joins.exactly_one(c, "call").collect()] == [(2, "c")]


def test_streamed_bursts_equal_batch(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:01"), ("z", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.start_debounced(stream, "10 seconds", "1 minute", "bursts", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in changes.debounced(df, "10 seconds").collect() if r["path"] != "z"}
    assert {tuple(r) for r in spark.table("bursts").collect()} == batch


def test_upsert_keeps_the_latest(spark, tmp_path):
    schema = "k string, n long, v string"
    for i, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = changes.start_upsert(spark.readStream.schema(schema).json(str(tmp_path / "in")), "k", "n", str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    last = spark.read.schema(schema).parquet(str(tmp_path / "out" / "generation=1"))
    assert sorted(tuple(r) for r in last.collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        fx.identifier_words(F.lit("parseHTTPHeader_v2")).alias("w"),
        fx.slug(F.lit(" Éa b!_c ")).alias("s"),
        fx.backticks(F.lit("`a` x `b` `a` `1x`")).alias("b"),
        fx.comment_text(F.lit("  /// hi ")).alias("c"),
        fx.is_identifier(F.lit("a-b")).alias("i"),
    ).first()
    assert (row["w"], row["s"], row["b"], row["c"], row["i"]) == ("parse HTTP Header v2", "éa-b_c", ["a", "b"], "hi", False)
