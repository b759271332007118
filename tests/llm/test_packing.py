import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusql.llm.bpe import default_vocabulary
from corpusql.llm.packing import Plan, pack_histogram, packed


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packs_everything_once(seed):
    rng = random.Random(seed)
    size = 64
    counts = {rng.randrange(1, size + 1): rng.randrange(1, 300) for _ in range([1, 1, 5, 30, 60, 64][seed])}
    if seed == 0:
        counts = {}
    plan = Plan(pack_histogram(counts, size))
    sequences = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            parts = sorted(plan.of(length, rank))
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
            assert sum(p[1] for p in parts) == length
            for _, part, sequence, offset in parts:
                sequences[sequence].append((offset, part))
    assert sorted(sequences) == list(range(len(sequences)))
    fills = []
    for spans in sequences.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        fills.append(sum(n for _, n in spans))
    assert sum(f < size for f in fills) <= 1 and all(f <= size for f in fills)


@pytest.mark.parametrize("size", [16, 1024])
def test_pieces_hold_all_ids(spark, documents, size):
    rng = random.Random(size)
    texts = [None, "", "a", "<|endoftext|>", "long " * 5000] + ["same text here"] * 40
    texts += [" ".join(rng.choice(["of", "the", "thingtion", "é"]) for _ in range(rng.randrange(900))) for _ in range(30)]
    df = documents(texts + [(2, "a"), (None, "no id")]).withColumn("length", F.lit("clash"))
    rows = packed(df, size=size).collect()
    library = Tokenizer.from_file(default_vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in [*enumerate(texts), (None, "no id")]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        if doc == 2:
            parts = parts[::2] if len(parts) == 4 else parts[:1]
        at = 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(ids)
            raw = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
    fills = []
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        fills.append(spans[-1][0] + spans[-1][1])
    assert sorted(by_sequence) == list(range(len(fills)))
    assert sum(f < size for f in fills) <= 1 and max(fills) <= size


@pytest.mark.parametrize("text", [" " * 2_000_000, " \n\t" * 500_000 + "end", "a" * 2_000_000])
def test_long_runs(documents, text):
    rows = packed(documents([text, "short"])).collect()
    ids = Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids + [0]
    raw = np.array(ids, "<u4").tobytes()
    mine = sorted((r for r in rows if r.doc_id == 0), key=lambda r: r.start)
    assert sum(r.length for r in mine) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) for r in mine)


def test_empty_table(documents):
    assert packed(documents(["a"]).limit(0)).count() == 0
