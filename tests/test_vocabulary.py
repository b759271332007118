from collections import Counter

import pytest

from corpusql.operators.training import training_records
from corpusql.operators.vocabulary import encoded, token_dictionary

ROWS = [
    (1, ["b", "a", "b", "c"], "x"), (2, ["b", "a", "b", "c"], "y"), (3, [], "z"), (4, None, None),
    (5, ["é", "日本", "a", None, "rare"], "x"), (6, ["é", "日本"] + ["long" * 200] * 3, "x"),
    (7, [f"w{i % 50}" for i in range(400)], "x"), (7, ["lone"], None),
]


@pytest.fixture
def lists(spark):
    # Columns named like the helper's own.
    return spark.createDataFrame(ROWS, "list long, tokens array<string>, row string")


def expected(least):
    counts = Counter(w for _, words, _ in ROWS for w in words or [] if w is not None)
    ranked = sorted((-n, w.encode(), w) for w, n in counts.items() if n >= least)
    return {w: (-n, i) for i, (n, _, w) in enumerate(ranked, 2)}


@pytest.mark.parametrize("least", [1, 2, 5])
def test_ids_are_dense_by_frequency(lists, least):
    got = {r.token: (r.n, r.id) for r in token_dictionary(lists, "tokens", least).collect()}
    assert got == expected(least)


@pytest.mark.parametrize("head", [0, 3, 20_000])
def test_lists_as_ids(lists, head):
    known = token_dictionary(lists, "tokens")
    got = encoded(lists, "tokens", known, "ids", head)
    assert got.columns == ["list", "tokens", "row", "ids"]
    want = expected(2)
    key = lambda r: (r[0], str(r[1]), str(r[2]), r[3])
    ids = lambda words: None if words is None else [want.get(w, (0, 1))[1] for w in words]
    assert sorted(map(key, got.collect())) == sorted(
        key((n, words, row, ids(words))) for n, words, row in ROWS
    )


def test_empty_tables(lists):
    none = token_dictionary(lists.limit(0), "tokens")
    assert none.count() == 0
    assert encoded(lists.limit(0), "tokens", none, "ids").count() == 0
    assert encoded(lists, "tokens", none, "ids").where("exists(ids, x -> x <> 1)").count() == 0


def test_records_with_a_dictionary(spark):
    df = spark.createDataFrame([("t", "q", "select a from t"), (None, None, None)], "schema_ddl string, question string, sql string")
    words = spark.createDataFrame([("select", 2), ("from", 3), ("t", 4)], "token string, id long")
    first, empty = sorted(training_records(df, max_length=64, dictionary=words).collect(), key=lambda r: r.sql or "", reverse=True)
    assert [x for x in first.labels if x != -100] == [2, 1, 3, 4]
    assert all(len(r[c]) == 64 for r in (first, empty) for c in ("input_ids", "attention_mask", "labels"))
    assert sum(first.attention_mask) == sum(x != 0 for x in first.input_ids)
    assert not [x for x in empty.labels if x != -100]
