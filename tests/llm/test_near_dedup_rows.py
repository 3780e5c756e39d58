"""Near-dedup of the pipeline decides row by row, not by doc_id alone."""

import random
from collections import Counter

import corpus_pipeline
from fathomry.llm import common


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(4)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    # copies of one id, a null id alone, a null id with a copy, copies that all lack an id, one id with two texts
    rows = [(1, a), (1, a), (None, b), (None, c), (7, c), (3, c), (None, d), (None, d), (1, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = common.staged(spark, corpus_pipeline.near_dedup(spark, docs, ""), "kept")
    want = Counter([(1, a), (None, b), (3, c), (None, d), (1, e)])
    assert Counter(map(tuple, kept.collect())) == want
    # the stages that follow take rows without an id
    cut = common.staged(spark, corpus_pipeline.substring_dedup(spark, kept, ""), "cut")
    assert Counter(map(tuple, cut.collect())) == want
    assert corpus_pipeline.pack(spark, cut, "").count() >= 5
