import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusql.llm.substring_dedup import _shared_rows, difference_cover, without_repeats


def brute(rows, window):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((doc, kept, len(words), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", [1, 2, 7, 13, 31, 40, 50])
def test_cover_has_every_difference(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window, period", [(50, 31), (12, 7), (8, 8)])
def test_equals_brute_force(spark, documents, window, period):
    rng = random.Random(window)
    vocabulary = ["a", "b", "é", "　", "x y", "word", "of", "the"] + [f"w{i}" for i in range(50)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(n) for n in (window - 1, window, window + 1, 3 * window)]
    rows = [(None, " ".join(passages[3])), (0, None), (1, ""), (2, " \t\n"), (3, "one")]
    for doc in range(10, 60):
        words = prose(rng.randrange(0, 2 * window))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((doc, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(70, "spam " * 500), (71, "spam " * 120), (72, "spam " * window), (20, "spam " * 90)]
    rows += [rows[10], rows[11]]
    df = documents(rows).withColumn("kept", F.lit(1)).withColumn("lo", F.lit("x"))
    got = without_repeats(df, window, period)
    assert got.columns == ["doc_id", "text", "lo", "kept", "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got.collect()), key=str)
    assert got == brute(rows, window)


def test_runs_across_batches():
    rows = [(1, 5), (2, 1), (2, 1), (2, 3), (3, 4), (3, 4), (4, 1), (4, 2), (4, 2), (4, 9), (5, 0), (5, 1)]
    for size in range(1, len(rows) + 1):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + size])], ["k", "doc"])
            for at in range(0, len(rows), size)
        ]
        read = lambda job: sorted(
            tuple(r.values()) for b in job(iter(batches)) for r in b.to_pylist()
        )
        assert read(_shared_rows(1, False)) == [(2, 3), (4, 2), (4, 2), (4, 9), (5, 1)]
        got = set(read(_shared_rows(1, True)))
        assert got == {(2, 1), (2, 3), (4, 1), (4, 2), (4, 9), (5, 0), (5, 1)}


def test_empty_table(documents):
    assert without_repeats(documents([(1, "a")]).limit(0)).count() == 0
