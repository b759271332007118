import numpy as np
from pyspark.sql import functions as F

from corpusql.llm.language_id import (
    BLOCK, CODES, LIMIT_PIECES, Space, held_out, identified, language_of, learn, limits, profiles,
)

SF = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_letter_is_one():
    space = Space()
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    others = [c for c in range(0x30000) if not chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 50):
        assert len(space.grams(" ".join(map(chr, letters[at : at + 50])))) > 0
    assert all(len(space.grams(chr(c))) for c in letters if c < 0x3000)
    assert not len(space.grams("".join(map(chr, others))))
    assert np.array_equal(space.grams("İz"), space.grams("iz"))


def test_grams_by_hand_and_across_blocks():
    space = Space()
    code = lambda s: sum((ord(c) if c != " " else 0) * CODES ** (2 - i) for i, c in enumerate(s))
    assert dict(space.grams("Ab,  b!").tolist()) == {code(" ab"): 1, code("ab "): 1, code("b b"): 1, code(" b "): 1}
    assert len(space.grams("  12 \n")) == len(space.grams("")) == 0
    text = "word é日本 " * (BLOCK // 4)
    one = dict(space.grams(text[: BLOCK - 1]).tolist())
    assert sum(one.values()) > BLOCK // 2
    # The same n-grams whether or not a block border cuts the text.
    whole = space.grams(text)
    n = len(text) // len("word é日本 ")
    assert dict(whole.tolist())[code("wor")] == n


def test_vectors_bind_order():
    space = Space()
    a, b = space.vectors(np.array([1 * CODES**2 + 2 * CODES + 3, 3 * CODES**2 + 2 * CODES + 1]))
    assert abs(int(a.astype(int) @ b.astype(int))) < 150
    assert set(np.unique(a)) == {-1, 1}


def test_odd_rows(spark):
    rows = [(1, "the cat and the hat", "en"), (2, None, "en"), (3, "", "de"), (4, "123 !!", None),
            (5, "der hund und die katze", "de"), (None, "der hund", "de"), (5, "the the the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    langs, prototypes = profiles(df)
    assert langs == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in identified(df, langs, prototypes).collect()]
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "de"), (5, "en")]
    assert [r.lang_pred for r in identified(df.limit(1), [], np.zeros((0, 512))).collect()] == ["und"]
    assert language_of(df.limit(0)).count() == 0


def test_limits_come_from_every_learning_row(spark):
    long = F.concat_ws(" ", F.lit("the quick brown fox jumps over the lazy dog and runs on and on to"), F.col("doc_id"))
    docs = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (F.col("id") % 130 == 0).alias("is_long")
    ).withColumn("text", F.when(F.col("is_long"), long).otherwise("some more words here"))
    learned = docs.where(~held_out())
    # Enough long texts in all, too few in every second row.
    assert LIMIT_PIECES <= learned.where("is_long").count() < 2 * LIMIT_PIECES - 10
    langs, prototypes = learn(docs)
    found = dict(limits(docs, langs, prototypes))
    assert max(found) == 6
    pieces = learned.where("is_long").select(F.expr("substring(text, 1, 64)").alias("text"))
    scores = sorted(r.score for r in identified(pieces, langs, prototypes).collect())
    assert found[max(found)] == int(scores[-(-len(scores) * 5 // 100) - 1] * 10_000) / 20_000
