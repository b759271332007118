import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusql.llm.line_dedup import MIN_WORDS, VARIABLE, keys, line_digests, masked, parse, without_recurring_lines


def brute(rows, min_docs):
    """One leaf at a time on the driver."""
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n") if doc is not None else []:
            words = masked(line)
            if len(words) >= MIN_WORDS:
                docs[tuple(words)].add(doc)
    leaves = defaultdict(list)
    for words in docs:
        leaves[keys(list(words))[0]].append(words)
    drop = defaultdict(set)
    for lines in leaves.values():
        if len(set().union(*(docs[w] for w in lines))) < min_docs:
            continue
        lines.sort(key=lambda w: (-len(docs[w]), keys(list(w))[1]))
        member, heads = parse([list(w) for w in lines], 0.7)
        for t in range(len(heads)):
            own = [w for w, m in zip(lines, member) if m == t]
            seen = set().union(*(docs[w] for w in own))
            if len(seen) >= min_docs:
                for w in own:
                    for doc in docs[w] - {min(seen)}:
                        drop[doc].add(w)
    out = []
    for doc, text in rows:
        lines = None if text is None else text.split("\n")
        kept = text if lines is None else "\n".join(x for x in lines if tuple(masked(x)) not in drop[doc])
        out.append((doc, kept))
    return sorted(out, key=str)


def test_parse_generalises():
    lines = [masked(x) for x in (
        "user 17 logged in from north today", "user 99 logged in from south today", "user 5 was sent away for good",
        "user 6 logged in from east now",
    )]
    member, heads = parse(lines, 0.7)
    assert member == [0, 0, 1, 0]
    assert heads[0] == ["user", VARIABLE, "logged", "in", "from", VARIABLE, VARIABLE]
    assert parse([], 0.7) == ([], [])


def test_equals_brute_force(spark, documents):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["of", "the", "a", "thing", "é", "word"]) for _ in range(rng.randrange(1, 14)))
    rows = [(None, "Licensed under the licence of somebody"), (0, None), (1, ""), (2, "\n\n")]
    for doc in range(5, 80):
        lines = [prose() for _ in range(rng.randrange(5))]
        if rng.random() < 0.6:
            lines.append(f"Copyright {rng.randrange(3000)} by the owners of page {doc}")
        if rng.random() < 0.3:
            lines.append(f"Licensed under the licence of {rng.choice(['somebody', 'nobody', 'all'])}")
        rng.shuffle(lines)
        rows.append((doc, "\n".join(lines)))
    rows += [rows[7], (90, "x " * 50_000)]
    df = documents(rows).withColumn("line", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    out = without_recurring_lines(df).collect()
    assert sorted(((r.doc_id, r.kept_text) for r in out), key=str) == brute(rows, 10)
    assert sum(r.n_dropped for r in out) > 30
    assert without_recurring_lines(df.limit(0)).count() == 0


def test_blocks_of_a_large_leaf_meet(spark, documents, monkeypatch):
    monkeypatch.setattr("corpusql.llm.line_dedup.BLOCK_LINES", 4)
    rows = [(i, f"seen at the corner of street{'abcdefghij'[i % 10]}x{'klmno'[i % 5]} again") for i in range(60)]
    out = {r.doc_id: r.n_dropped for r in line_digests(documents(rows)).collect()}
    assert out == {i: int(i > 0) for i in range(60)}


def test_short_lines_recur_as_they_stand(documents):
    rows = [(i, f"own {'abcdefghijklmnopqrst'[i]}\nAll rights reserved.\nPage {i}\n---\nPage 1 of 2") for i in range(20)]
    rows += [(i, "rare line") for i in range(30, 39)]
    out = {r.doc_id: r for r in without_recurring_lines(documents(rows)).collect()}
    assert out[0].kept_text == rows[0][1] and all(out[i].n_dropped == 0 for i in range(30, 39))
    for i in range(1, 20):
        assert out[i].kept_text == f"own {'abcdefghijklmnopqrst'[i]}\nPage {i}\n---"


def test_number_rows_are_no_template(documents):
    rows = [(i, f"{i} {i + 1} {i + 2} {i + 3} {i + 4}\n7 7 7 7 7 7\nread {i} of the {i} books") for i in range(20)]
    out = {r.doc_id: r.kept_text for r in without_recurring_lines(documents(rows)).collect()}
    assert out[0] == rows[0][1]
    assert all(out[i] == rows[i][1].split("\n")[0] for i in range(1, 20))
