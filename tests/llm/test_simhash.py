import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusql.llm.simhash import components, forest, link_digests, near_duplicates, one_of_each


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, ids):
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(values[a] ^ values[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("AÉbcdefgh") + rng.choice("xyz")
    texts = [None, "", "one", "ONE", "one two", "Über É", " \n\t"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts.append("long text " * 30_000)
    rng.shuffle(texts)
    return texts


def test_equals_brute_force(spark, documents):
    texts = corpus()
    df = documents(texts + [(5, texts[5]), (None, texts[6])]).withColumn("bits", F.lit("clash"))
    rows = link_digests(df).collect()
    assert len(rows) == len(texts) + 2
    values = {i: fingerprint(t) for i, t in enumerate(texts)}
    want = linked(values, list(values))
    assert len(set(want.values())) < len(set(values.values()))  # links between different texts
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == f"{values[6]:016x}"
        else:
            assert (r.fingerprint, r.component_id) == (f"{values[r.doc_id]:016x}", want[r.doc_id])
    kept = sorted(r.doc_id for r in one_of_each(df.where("doc_id IS NOT NULL")).collect())
    assert set(kept) == set(want.values())


def test_empty_table(documents):
    assert near_duplicates(documents(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_forest_joins_what_links_join(seed):
    rng = np.random.default_rng(seed)
    n = 60
    bits = rng.integers(0, 1 << 10, n).astype("u8")
    visits = rng.random(n) < 0.5
    node = np.arange(n)

    def roots(edges):
        root = list(range(n))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    pairs = [
        (a, b) for a in range(n) for b in range(a)
        if not (visits[a] and visits[b]) and bin(int(bits[a] ^ bits[b])).count("1") <= 2
    ]
    edges = forest(node, bits, visits, 2)
    assert roots(edges) == roots(pairs)
    assert len(edges) <= n + (~visits).sum() + len(pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame(
        [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9)], "u long, v long"
    )
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3}
