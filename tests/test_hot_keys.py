"""Names that thousands of symbols share: the same rows as SQL, without a task or a join that grows with their square."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomry import catalogue
from fathomry.operators import joins


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    """A folder with few names, brands and types, so that groups are large and lines tie."""
    folder, rnd = tmp_path_factory.mktemp("hot"), random.Random(11)
    n = 1500
    part = {
        "p_partkey": range(n),
        "p_name": [rnd.choice(["red widget", "red widget", "promo.1", f"lone {i % 900}"]) for i in range(n)],
        "p_brand": [rnd.choice(["Brand#1", "Brand#1", "Brand#2", f"Brand#{i}"]) for i in range(n)],
        "p_type": [rnd.choice(["PROMO", "SMALL", f"T{i % 300}"]) for i in range(n)],
        "p_size": pd.array([rnd.choice([None, *range(1, 50)]) for _ in range(n)], "Int32"),
        "p_retailprice": [1.0] * n,
    }
    keys = [rnd.randrange(n) for _ in range(4 * n)]
    line = {"l_orderkey": [i // 4 for i in range(4 * n)], "l_linenumber": [i % 4 + 1 for i in range(4 * n)], "l_partkey": keys, "l_suppkey": [rnd.choice([1, 3, 9]) for _ in keys]}
    for name, rows in (("part", part), ("lineitem", line)):
        pd.DataFrame(rows).to_parquet(folder / f"{name}.parquet", index=False)
    return str(folder)


def plain(rows) -> list:
    return sorted(repr([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r]) for r in rows)


def equal_to_sql(spark, folder: str, name: str) -> pd.DataFrame:
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, folder).toPandas()
    assert plain(got[list(want.columns)].astype(object).itertuples(index=False, name=None)) == plain(want.astype(object).itertuples(index=False, name=None))
    return got


def most_rows(spark) -> int:
    """Rows that the largest node of the last query made."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsCount() - 1
    run = store.executionsList(last, 1).apply(0)
    values, most = store.executionMetrics(run.executionId()), 0
    for metric in (run.metrics().apply(i) for i in range(run.metrics().size())):
        if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
            most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_pairs_of_one_anchor_are_dealt_over_tasks(spark, hot, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_BLOCK", 64, raising=False)
    got = equal_to_sql(spark, hot, "join_anchor_symbols")
    by_task = catalogue.queries()["join_anchor_symbols"](spark, hot).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(got) > 50_000 and by_task.max() < 0.7 * by_task.sum()


@pytest.mark.parametrize("name", ["join_disambiguate", "join_language_tier", "join_defines_containment", "join_import_tier"])
def test_no_pairs_are_made(spark, hot, name):
    equal_to_sql(spark, hot, name)
    catalogue.queries()[name](spark, hot).write.format("noop").mode("overwrite").save()
    assert most_rows(spark) < 5 * (6000 if name == "join_import_tier" else 1500)


def test_islands_hold_no_table(spark):
    from fathomry.operators import ranking

    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(30)])) for _ in range(60)] + [(3, 7), (3, 7), (3, 8), (4, None), (4, None)]
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["k", "n"], dtype="Int64"))
    want = con.execute("WITH r AS (SELECT DISTINCT k, n FROM t), g AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS g FROM r) SELECT k, min(n), max(n), count(*) FROM g GROUP BY k, g").fetchall()
    got = ranking.islands(spark.createDataFrame(rows, "k long, n long"), "k", "n")
    assert plain(map(tuple, got.collect())) == plain(want)
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_orders_of_classes_come_in_batches(spark):
    from fathomry.operators import resolution

    rnd = random.Random(8)
    rows = sorted({(a, rnd.randint(a + 1, a + 9)) for a in range(200) for _ in range(3)})
    parents = [(a, b, rnd.randint(1, 2)) for a, b in rows]  # positions tie: the smaller parent comes first
    lists = {}
    for a, b, _ in sorted(parents, key=lambda r: (r[2], r[1])):
        lists.setdefault(a, []).append(b)

    def upto(a, depth):
        return {a: lists[a]} | {k: v for b in lists[a] if depth and b in lists for k, v in upto(b, depth - 1).items()}

    want = sorted((a, i, x) for a in lists for i, x in enumerate(resolution.c3(a, upto(a, 2)) or []))
    got = resolution.mro(spark.createDataFrame(parents, "src long, dst long, position int"), 2)
    assert sorted(map(tuple, got.collect())) == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def _texts(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 40)))) for i in range(400)] + [(1000, None), (1001, ""), (None, "a b")]
    return spark.createDataFrame(rows, "id long, text string").repartition(2)


def test_postings_travel_in_blocks(spark):
    from fathomry.operators import aggregates

    stored = aggregates.postings(_texts(spark), "id", {"text": "text"})
    assert stored.count() <= 2 * 8


def test_scores_do_not_follow_the_order_of_postings(spark):
    from fathomry.operators import aggregates

    t, fields = _texts(spark), {"text": "text"}
    stored, sizes = aggregates.postings(t, "id", fields), aggregates.lengths(t, fields)
    told = [sorted(map(tuple, aggregates.bm25_of(stored.repartition(1).sortWithinPartitions(order).localCheckpoint(), sizes, list("badhc")).where("id is not null").collect())) for order in (F.asc("term"), F.desc("term"))]
    assert len(told[0]) > 300 and told[0] == told[1]
