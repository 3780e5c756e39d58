"""Bounds follow the spread of a group's own texts."""

import random

from fathomry.llm import quality


def test_bounds_follow_the_group(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    text = lambda rate: " ".join(word() + ("|" if rnd.random() < rate else "") for _ in range(80))
    rows = [(i, text(0.0), "en", "prose") for i in range(400)] + [(1000 + i, text(0.5), "en", "prose") for i in range(20)]
    # the same rate where it is usual, and words of seven letters on average where five are usual
    rows += [(2000 + i, text(rnd.uniform(0.1, 0.7)), "en", "tables") for i in range(400)]
    rows += [(3000 + i, " ".join(word() + "xyz" for _ in range(80)), "en", "prose") for i in range(20)]
    kept = {r["doc_id"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == {r[0] for r in rows if not 1000 <= r[0] < 2000 and r[0] < 3000}
