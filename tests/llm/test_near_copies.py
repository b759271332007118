import random

import corpus_pipeline
from corpusql.llm import near_copies as module
from corpusql.llm.near_copies import near_copies, shingles


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    out = [None, "", " \n", "one two", "ONE two"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 300))] + passage
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 25 + 1)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def brute(texts):
    sets = [set(shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_equals_brute_force(documents):
    rows = texts()
    want = brute(rows)
    assert 15 < len(set(want)) < len(rows) - 10
    got = {r.doc_id: r.component_id for r in near_copies(documents(rows)).collect()}
    assert got == dict(enumerate(want))


def test_pages_of_one_template_are_not_all_compared(documents, monkeypatch):
    """600 texts with 170 common and 25 own words: none is near, few are candidates."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    template = [word() for _ in range(170)]
    rows = [" ".join(template + [word() for _ in range(25)]) for _ in range(600)]
    made = []
    keep = module.work_table
    monkeypatch.setattr(module, "work_table", lambda df, name, *batch: made.append((name, keep(df, name, *batch))) or made[-1][1])
    got = {r.doc_id: r.component_id for r in near_copies(documents(rows)).collect()}
    assert got == {i: i for i in range(600)}
    assert sum(t.count() for name, t in made if name == "pairs") < 6000


def test_repeated_ids_nulls_and_long_texts(documents):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base + " tail"), (3, "other words of some text here"), (3, base + " more"), (None, base),
            (4, None), (5, " "), (6, "long text " * 300_000), (7, "long text " * 300_001), (8, "other words of some text here")]
    got = {r.doc_id: r.component_id for r in near_copies(documents(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 4: 4, 5: 4, 6: 6, 7: 6}
    assert near_copies(documents(rows).limit(0)).count() == 0


def test_stage_drops_edited_copies(spark, documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(20):
        base = [word() for _ in range(400)]
        copy = [word() if at % 60 == 20 else w for at, w in enumerate(base)]
        rows += [" ".join(base), " ".join(copy), " ".join(base[:200] + [word() for _ in range(200)])]
    kept = corpus_pipeline.near_copies(spark, documents(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(60) if i % 3 != 1]


def test_few_rows_lie_in_few_files(spark, documents, monkeypatch):
    """However many partitions shuffles have, tables of few rows have a file for each core at most."""
    made = []
    keep = module.work_table
    monkeypatch.setattr(module, "work_table", lambda df, name, *batch: made.append((name, keep(df, name, *batch))) or made[-1][1])
    rows = texts()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in near_copies(documents(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == dict(enumerate(brute(rows)))
    cores = spark.sparkContext.defaultParallelism
    kept = [(name, t) for name, t in made if name not in ("counts", "places", "left")]  # the others are discarded
    assert len(kept) > 10
    assert all(len(t.inputFiles()) <= cores for _, t in kept)
