"""Fingerprints tell likenesses finely enough."""

import collections
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tamga.llm import fingerprints


def test_likeness_error(spark):
    # 400 pairs of texts that share 20 of 40 tokens, and 400 that share 2 of 40
    rows = [(4 * i + 2 * k + s, " ".join(f"{i}.{k}.{w if w < same else (s, w)}".replace(" ", "") for w in range((40 + same) // 2))) for i in range(400) for k, same in ((0, 20), (1, 2)) for s in (0, 1)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id")
    a, b = got.where("doc_id % 2 = 0"), got.select((F.col("doc_id") - 1).alias("doc_id"), F.col("symbols").alias("other"))
    said = {r.doc_id: r.x for r in a.join(b, "doc_id").select("doc_id", fingerprints.likeness(F.col("symbols"), F.col("other")).alias("x")).collect()}
    half, few = [said[4 * i] for i in range(400)], [said[4 * i + 2] for i in range(400)]
    assert abs(sum(half) / 400 - 0.5) < 0.02 and (sum((x - 0.5) ** 2 for x in half) / 400) ** 0.5 < 0.09
    assert sum(x == 0 for x in few) / 400 < 0.2


def plain_fingerprint(text):
    """The samples of one text, term by term: hashes seeded one with the other, 21 bits of each for a number."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    unit = lambda x, k: ((x >> 21 * k & ((1 << 21) - 1)) + 0.5) / (1 << 21)
    terms = collections.Counter(re.split(r"[ \t\n\x0b\f\r]", text))
    token = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in terms}
    out = []
    for k in range(fingerprints.SAMPLES):
        best = math.inf
        for word, n in terms.items():
            one, two = (xxhash.xxh64_intdigest((k * 2 + j).to_bytes(4, "little"), xxhash.xxh64_intdigest(signed(token[word]).to_bytes(8, "little", signed=True), 42)) for j in range(2))
            r = -math.log(unit(one, 0) * unit(one, 1))
            ln_c = math.log(-math.log(unit(two, 0) * unit(two, 1)))
            beta = unit(one, 2)
            t = math.floor(math.log(n) / r + beta)
            best = min(best, ln_c - r * (t - beta + 1))
        out.append(best)
    return out


def test_samples_against_plain(spark):
    """Scores of the samples equal a plain version's; the symbol of a sample is a hash of its score."""
    rnd = random.Random(3)
    texts = ["", "a", "a a a a b", "é日本😀 x\ty", *(" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) for _ in range(30))]
    got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id")
    said = {r.doc_id: r.symbols for r in got.collect()}
    plain = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(plain_fingerprint(t))]
    # logarithms may differ in the last place between libraries, so neighbours of a score count as the score
    near = [(i, k, y) for i, k, x in plain for y in (x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf), math.nextafter(math.nextafter(x, 9e9), 9e9), math.nextafter(math.nextafter(x, -9e9), -9e9))]
    symbols = spark.createDataFrame(near, "i int, k int, x double").select("i", "k", F.right(F.hex(F.xxhash64("x")), F.lit(8)).alias("s")).collect()
    could = collections.defaultdict(set)
    for r in symbols:
        could[r.i, r.k].add(r.s)
    hits = [said[i][k] in could[i, k] for i in range(len(texts)) for k in range(fingerprints.SAMPLES)]
    assert sum(hits) / len(hits) > 0.995


@pytest.mark.parametrize("quantiles,ranges,level", [(3, 2, 2), (3, 9, 2), (3, 40, 3), (256, 300, 4096)])
def test_neighbours_over_ranges(spark, monkeypatch, quantiles, ranges, level):
    """Ranges grow with the id, also where ids are clustered, and each knows the next one that has rows."""
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    monkeypatch.setattr(fingerprints, "LEVEL", level)
    rnd = random.Random(4)
    ids = sorted({*(rnd.randint(0, 200) for _ in range(150)), *(10**12 + rnd.randint(0, 50) for _ in range(60)), 10**18})
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,), (7,), (7,)], "id bigint")
    got = sorted((r.id, r.range) for r in fingerprints._ranged(rows, ranges).where("id is not null").collect())
    assert [r for _, r in got] == sorted(r for _, r in got) and len({r for _, r in got}) > min(ranges, 20) // 3
    numbers = sorted({r for _, r in got})
    heads = spark.createDataFrame([(r,) for r in numbers], "range bigint")
    assert {r.range: r.to for r in fingerprints._next_range(heads).collect()} == dict(zip(numbers, numbers[1:] + numbers[:1]))
