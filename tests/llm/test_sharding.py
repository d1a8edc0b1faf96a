"""Shards: even sizes, gapless slots, groups together."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tamga.llm import sharding

SCHEMA = "doc_id bigint, text string"


def shares(rows):
    """Size of each shard, shards of each group, groups' sizes."""
    size, where, members = Counter(), defaultdict(Counter), Counter()
    for r in rows:
        size[r.shard] += r.size
        where[r.grp][r.shard] += 1
        members[r.grp] += 1
    return size, where, members


def held_law(docs, rows, shards=8):
    """What holds in any case."""
    say = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, *say(t)) for i, t in docs)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(0 <= r.shard < shards for r in rows)


def test_groups_stay_together_and_sizes_are_even(spark):
    rnd = random.Random(2)
    texts = [f"lone {i} " * rnd.randint(1, 30) for i in range(3000)]
    texts += [t for g in range(200) for t in [f"group {g} " * rnd.randint(1, 30)] * rnd.randint(2, 6)]
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    rows = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA)).collect()
    held_law(docs, rows)
    size, where, members = shares(rows)
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)
    assert all(len(x) == 1 for g, x in where.items() if members[g] > 1)


def test_a_third_of_all_is_one_group(spark):
    rnd = random.Random(4)
    texts = [f"lone {i} " * rnd.randint(1, 30) for i in range(2000)] + ["the same for all, the same for all, the same for all"] * 2000 + [f"pair {i // 2}" for i in range(400)]
    docs = list(enumerate(texts))
    rows = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA)).collect()
    held_law(docs, rows)
    size, where, members = shares(rows)
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)
    hot = max(members, key=members.get)
    need = -(-sum(r.size for r in rows if r.grp == hot) // (sum(size.values()) // 8))
    assert len(where[hot]) <= need + 1
    assert sum(len(x) > 1 for g, x in where.items() if g != hot) <= 4


def test_many_empty_texts(spark):
    # few bytes but many rows: such a group is a large one too
    docs = [(i, None if i % 2 else "") for i in range(3000)] + [(3000 + i, f"text {i} " * 40) for i in range(500)]
    rows = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA)).collect()
    held_law(docs, rows)
    size, where, members = shares(rows)
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows)


def test_only_copies(spark):
    docs = [(i, "x" * 50) for i in range(1000)]
    rows = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA)).collect()
    held_law(docs, rows)
    assert sorted(Counter(r.shard for r in rows).values()) == [125] * 8


def test_only_pairs(spark):
    docs = [(i, f"pair {i // 2:04}") for i in range(1600)]
    rows = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA)).collect()
    held_law(docs, rows)
    size, where, members = shares(rows)
    assert max(size.values()) - min(size.values()) <= 2 * 11
    assert sum(len(x) > 1 for x in where.values()) <= 8


def test_odd_rows_and_own_groups(spark):
    docs = [(1, "a"), (1, "a"), (None, "b"), (None, None), (2, ""), (3, "long " * 5000)]
    df = spark.createDataFrame([(i, t, k % 2 or None, 9) for k, (i, t) in enumerate(docs)], f"{SCHEMA}, g int, shard int")
    for group in (None, "g"):
        rows = sharding.balanced_shards(df, shards=3, group_col=group).collect()
        held_law(docs, rows, 3)
    assert sharding.balanced_shards(spark.createDataFrame([], SCHEMA)).collect() == []
    one = sharding.balanced_shards(spark.createDataFrame(docs, SCHEMA), shards=1).collect()
    held_law(docs, one, 1)
    with pytest.raises(ValueError):
        sharding.balanced_shards(df, shards=0)


def test_quotas_keep_to_the_room():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        wanted, room = rnd.integers(0, 1000, (8, 8)).astype(float), rnd.integers(0, 900, 8).astype(float)
        np.fill_diagonal(wanted, 0)
        share = sharding.quotas(wanted, room)
        moved = wanted * share
        assert (share > 0).any() and (moved.sum(0) <= room + moved.sum(1) + 1).all()


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    rows = sharding.op11(spark, path).collect()
    held_law(docs, rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)
    text, at = dict(docs), defaultdict(set)
    for r in rows:
        at[text[r.doc_id]].add(r.shard)
    assert sum(len(x) > 1 for x in at.values()) <= 3
