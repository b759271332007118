import random

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(10_000, None, "en", "s", None), (10_001, "", None, "s", 0), (10_002, "12 34 !!", "en", None, 8), (None, "the cat sat on the mat", "en", "s", 22)],
        docs.schema,
    )
    now = docs.union(odd).withColumn("score", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, SF).persist()
        assert now.columns == before.columns
        kept[name] = {r.doc_id: r for r in now.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
        assert all(r.text is None or r.n_chars == len(r.text) for r in kept[name].values())
    first = {r.doc_id: r for r in docs.collect()}
    assert {10_000, 10_001, 10_002}.isdisjoint(kept["language_id"]) and None in kept["language_id"]
    assert len(kept["language_id"]) > 0.97 * len(first)
    right = sum(r.lang == first[i].lang for i, r in kept["language_id"].items() if i in first)
    assert right > 0.97 * len(first)
    assert set(kept["line_dedup"]) == set(kept["language_id"])
    assert set(kept["substring_dedup"]) == set(kept["simhash_and_prefix_join"]) and len(kept["simhash_and_prefix_join"]) < len(kept["line_dedup"])
    # Each text once after the near copies are gone.
    texts = [r.text for r in kept["simhash_and_prefix_join"].values()]
    assert len(set(texts)) == len(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept["substring_dedup"])


CLASHES = ["_lang", "score", "lang_pred", "_known", "_gone", "_doc", "_wanted", "_copy", "copy_id", "n_words",
           "n_removed", "kept", "n_lines", "n_dropped", "kept_text", "row", "node", "sign", "place"]


def test_columns_of_any_name_survive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.lit(-7.5).alias(c) for c in CLASHES)).persist()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) > 30 and all(r[c] == -7.5 for r in rows for c in CLASHES)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    fills = [r.n for r in rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < 1024 for n in fills) <= 1 and max(fills) <= 1024


def test_unlearned_languages_and_random_letters_go(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        noise(30), noise(300), noise(1500),
    ]
    clean = [
        "the cat sat on the mat", "That it.",
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(foreign + clean)], docs.schema)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.union(odd), "").select("doc_id", "lang").collect()}
    assert len(kept.keys() - set(range(10**6, 2 * 10**6))) > 0.99 * docs.count()
    assert [kept.get(10**6 + i) for i in range(len(foreign))] == [None] * len(foreign)
    assert [kept.get(10**6 + len(foreign) + i) for i in range(4)] == ["en", "en", "en", "de"]
