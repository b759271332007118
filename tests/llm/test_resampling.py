import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusql.llm import resampling as module
from corpusql.llm.resampling import draw, key_digits, radix_ranked, resampled

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(SMALL))
    grams = words + [" ".join(p) for p in zip(words, words[1:])]
    return words, [zlib.crc32(g.encode()) % 10_000 for g in grams]


def brute(docs, target, percent=25):
    s, t = [0] * 10_000, [0] * 10_000
    for table, counts in ((docs, s), ([(0, x) for x in target], t)):
        for _, text in table:
            for b in features(text)[1]:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10_000)]
    rows = []
    for doc, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_equals_brute_force(documents, spark):
    rng = random.Random(3)
    words = ["The", "cat", "ÉTÉ", "été", "a1", "x-y", "日本", "It's", "\x00nul", "\x7fdel", "12", "İ"]
    docs = [(rng.choice([1, -1]) * rng.randrange(10**rng.randrange(1, 19)), t) for t in texts(rng, 300, words)]
    docs += [(7, None), (8, ""), (9, "... --"), (None, "no id " * 30), (None, "no id " * 30), (11, "long text " * 100_000)]
    docs += docs[:40]  # repeated rows
    target = [*texts(rng, 20, words[:4]), None]
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(target)], "item_id string, text string")
    df = documents(docs).repartition(7).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    assert got(resampled(df, bench)) == brute(docs, target)
    assert got(resampled(df, bench, percent=100)) == brute(docs, target, 100)
    kept = draw(df, bench)
    assert kept.columns == df.columns
    drawn = {r[0] for r in brute(docs, target) if r[4] is not None} - {None}
    assert {r.doc_id for r in kept.collect()} == drawn


def test_empty_tables(documents, spark):
    bench = spark.createDataFrame([("a", "some words")], "item_id string, text string")
    docs = [(i, "one two three " * i) for i in range(30)]
    assert resampled(documents(docs).limit(0), bench).count() == 0
    assert got(resampled(documents(docs), bench.limit(0))) == brute(docs, [])


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_radix_sort_is_a_stable_sort(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(block)
    keys = [rng.choice([0, 1, -1, 2**63 - 1, -(2**63), rng.randrange(-(2**63), 2**63), rng.randrange(5)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(keys)), "row long, key long").withColumn("place", F.lit("x")).repartition(6)
    found = radix_ranked(df, key_digits(F.col("key")), "digits")
    assert found.columns == ["row", "key", "place", "digits"]
    rows = sorted(found.collect(), key=lambda r: r.digits)
    assert [r.digits for r in rows] == list(range(400))
    assert [r.key for r in rows] == sorted(keys) and sorted(r.row for r in rows) == list(range(400))


def test_equal_keys_get_all_places(spark):
    df = spark.range(1000).select(F.lit(5).cast("long").alias("key"))
    assert sorted(r.rank for r in radix_ranked(df, key_digits(F.col("key"))).collect()) == list(range(1000))
