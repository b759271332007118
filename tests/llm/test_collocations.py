import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusql.llm import collocations as module
from corpusql.llm.collocations import best_collocations, collocations, frequent_phrases

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=10, length=3, absorbed=50, limit=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, length + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        able = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        gone = set()
        for p, a in able.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner = p[i : i + k]
                    if 100 * a >= absorbed * able[inner]:
                        gone.add(inner)
        mine = []
        for p, a in able.items():
            if p not in gone:
                cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["Of", "the", "house", "é", "日本", "a\x00b", "x\xa0y", "New", "York", "City", "–", "10%"]
    rows = [(None, None), ("en", None), ("en", ""), ("de", " \t\n.,"), ("fr", "word")]
    for _ in range(120):
        text = ""
        for _ in range(rng.randrange(40)):
            text += rng.choice(words[: rng.randrange(2, len(words) + 1)]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "? "])
            if rng.random() < 0.1:
                text += "new york city "
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + rows[:30]


@pytest.mark.parametrize("seed,length,limit", [(1, 3, 2000), (2, 3, 7), (3, 5, 2000), (4, 2, 2000)])
def test_equals_brute_force(spark, seed, length, limit):
    rows = corpus(seed)
    want = brute(rows, length=length, limit=limit)
    assert len(want) > 10
    assert got(best_collocations(table(spark, rows).repartition(5), limit, length=length)) == want


def test_lots_do_not_matter(spark, monkeypatch):
    rows = corpus(5)
    # Lots of 50 words: the setting travels with the function, by value.
    monkeypatch.setattr(module, "LOT", 50)
    assert got(best_collocations(table(spark, rows))) == brute(rows)


def test_overlaps_ties_and_exact_products(spark):
    rows = [("en", "ba " * 12), ("en", "x y"), *[("en", "q r s")] * 10, *[("en", "q r t")] * 10]
    assert got(best_collocations(table(spark, rows))) == brute(rows)
    # Products beyond 64 bits.
    big = 4 * 10**12
    none = "array<long>"
    one = spark.createDataFrame([(1, "en", "u", "u", big, [], [])], f"id long, lang string, phrase string, last string, f long, heads {none}, tails {none}")
    two = spark.createDataFrame(
        [(5, "en", "u v w", "w", big - 1, [big + 3, big + 7], [big + 9, big + 1], 1, 1)],
        f"id long, lang string, phrase string, last string, f long, heads {none}, tails {none}, left long, right long",
    )
    row = module._scored([one, two], 50).first()
    cuts = [(10**6 * (big - 1) ** 2 // (h * t), i, h, t) for i, (h, t) in enumerate([(big + 3, big + 9), (big + 7, big + 1)])]
    assert (row.score, row.l, row.r) == (min(cuts)[0], *min(cuts)[2:])


def test_very_long_text_and_many_languages(spark):
    rows = [("en", "one two three " * 70_000), *[(f"l{i}", "same words here " * 12) for i in range(60)]]
    assert got(best_collocations(table(spark, rows))) == brute(rows)


def test_empty_table_and_other_columns(spark):
    df = table(spark, [("en", "a b " * 20)])
    assert best_collocations(df.limit(0)).count() == 0
    assert best_collocations(table(spark, [("en", None), (None, "")])).count() == 0
    clash = df.withColumn("lot", F.lit("z")).withColumn("n", F.lit(-1)).withColumn("f", F.lit(None).cast("int"))
    assert got(best_collocations(clash)) == got(best_collocations(df))
    assert collocations(clash).count() == 2


def test_words_of_all_lengths(spark):
    found, totals = frequent_phrases(table(spark, [("en", "a b c. " * 15)]), length=3)
    assert [sorted((r.phrase, r.f) for r in t.collect()) for t in found] == [
        [("a", 15), ("b", 15), ("c", 15)], [("a b", 15), ("b c", 15)], [("a b c", 15)],
    ]
    assert [tuple(r) for r in totals.collect()] == [("en", 45)]
