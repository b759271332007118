import random

import numpy as np
from pyspark.sql import functions as F

from corpusql.llm.toxicity import Model, Scorer, fitted, learning_rows, scored, segments, toxicity_digests


def brute_segments(w):
    """Best segment, then the same left and right of it (minimal length among equals)."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += w[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (i, j + 1, total)
        if best:
            out.append(best)
            go(a, best[0])
            go(best[1], b)

    go(0, len(w))
    return sorted(out)


def test_segments_equal_recursion():
    rng = np.random.default_rng(5)
    for n in [0, 1, 2, 5, 20, 40] * 20:
        w = rng.normal(-0.3, 1, n)
        got, want = sorted(segments(w)), brute_segments(w)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 200))]
        if toxic := int(i % 6 == 0):
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "awful", "nasty"]) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(1000, None), (1001, ""), (1002, "\n "), (None, "vile awful"), (5, rows[5][1]), (1003, "w1 " * 60_000)]
    labels += [(1000, 0), (None, 1), (7, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity_digests(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(held) > 60
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.predicted for r in rows if r.doc_id and r.doc_id >= 1000} == {0}


def test_passages_are_found(spark):
    docs, labels = corpus(spark)
    model = fitted(learning_rows(docs, labels))
    row = scored(docs.where("doc_id = 6"), model).first()
    words = row.text.split()
    assert row.passages and {"vile", "awful", "nasty"} & set(words[row.passages[0].first : row.passages[0].past])
    assert Scorer(model).evidence("") == 0


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark)
    assert {r.predicted for r in toxicity_digests(docs, labels.limit(0)).collect()} == {0}
    assert toxicity_digests(docs.limit(0), labels).count() == 0
    assert scored(docs.limit(3), Model()).count() == 3
