import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from corpusql.llm import sharding as module
from corpusql.llm.sharding import Shard, Tree, regular, shard_digests, sharded


def brute(key, shards, regions=4, racks=4):
    """The regular tree of 64 places, walked plainly."""
    u = lambda t, path: (int.from_bytes(md5(f"{key}|{t}|{path}".encode()).digest()[:6], "big") + 0.5) / 2**48
    t = 0
    while True:
        region = min(range(regions), key=lambda r: -math.log(u(t, f"region{r}")))
        rack = min(range(racks), key=lambda k: -math.log(u(t, f"region{region}/rack{k}")))
        mine = [n for n in range(64) if n % regions == region and n // regions % racks == rack]
        shard = min(mine, key=lambda n: -math.log(u(t, f"region{region}/rack{rack}/{n}")))
        if shard < shards and u(t, f"region{region}/rack{rack}/{shard}/take") < 1:
            return shard
        t += 1


def test_equals_brute_force(documents):
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**6), 10**6), rng.choice([None, "", "same", "é" * 5, "text " * rng.randrange(50)])) for _ in range(400)]
    rows += [(None, "no id"), (None, None), *[(77, "copy")] * 60, (77, "other"), (78, "x" * 1_000_000)]
    df = documents(rows).repartition(5).withColumn("shard", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("slot", F.lit(1))
    found = shard_digests(df).collect()
    want = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        key = "" if doc is None else str(doc)
        want[doc, len(raw) + 16, zlib.crc32(raw), "key", brute(key, 40), brute(key, 41)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("block,lot", [(7, 3), (50_000, 1_000)])
def test_slots_do_not_depend_on_blocks(documents, monkeypatch, block, lot):
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    monkeypatch.setattr(module, "LOT", lot)
    rows = [(i % 150, "t") for i in range(600)] + [(5, "hot")] * 500
    slots = defaultdict(list)
    for r in sharded(documents(rows), regular(3)).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 1100
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("n", [1, 7, 39, 40, 41, 63])
def test_growth_moves_rows_into_the_new_shard_only(n):
    now, then = regular(n, room_for=64), regular(n + 1, room_for=64)
    moved = [(a, b) for a, b in ((now.of(str(k)), then.of(str(k))) for k in range(800)) if a != b]
    assert all(b == n for _, b in moved)
    assert len(moved) < 2.2 * 800 / (n + 1)


def places(**change):
    return [
        Shard(f"r{r}", f"k{k}", 100 * r + 10 * k + s, *change.get(f"s{r}{k}{s}", (1.0, 2.0)))
        for r in range(3) for k in range(2) for s in range(3)
    ]


def test_shares_follow_weights():
    tree = Tree(places(s000=(2.0, 2.0), s111=(0.5, 2.0), s222=(0.0, 2.0)))
    counts = Counter(tree.of(str(k)) for k in range(12_000))
    unit = 12_000 / (15 + 2.5)
    assert counts[222] == 0
    assert abs(counts[0] - 2 * unit) < 150 and abs(counts[111] - unit / 2) < 90 and abs(counts[102] - unit) < 110


def test_weights_move_rows_of_one_shard_only():
    before, after = Tree(places()), Tree(places(s111=(0.25, 2.0)))
    moved = [(a, b) for a, b in ((before.of(str(k)), after.of(str(k))) for k in range(3000)) if a != b]
    assert moved and all(a == 111 for a, _ in moved)
    after = Tree(places(s111=(1.75, 2.0)))
    moved = [(a, b) for a, b in ((before.of(str(k)), after.of(str(k))) for k in range(3000)) if a != b]
    assert moved and all(b == 111 for _, b in moved)


def test_more_room_moves_rows_into_its_region_only():
    full = [Shard(s.region, s.rack, s.shard) for s in places()]
    before, after = Tree(full), Tree([*full, Shard("r1", "k9", 999)])
    moved = [(a, b) for a, b in ((before.of(str(k)), after.of(str(k))) for k in range(3000)) if a != b]
    assert moved and all(b // 100 == 1 or b == 999 for _, b in moved)
    # Within the region, rows that stay in it move into the new rack only.
    assert all(b == 999 for a, b in moved if a // 100 == 1)


def test_bad_trees_are_refused():
    for bad in ([], [Shard("r", "k", 1, 0.0)], [Shard("r", "k", 1, 3.0, 2.0)], [Shard("r", "k", 1), Shard("q", "k", 1)]):
        with pytest.raises(ValueError):
            Tree(bad)


def test_empty_table(documents):
    assert shard_digests(documents(["a"]).limit(0)).count() == 0
