"""The generator's stream in parts equals the stream as a whole."""

import random
from collections import Counter

import numpy as np
import pytest

from tamga.functions import seeded


def test_polynomial_and_jumps():
    assert seeded.polynomial().bit_length() - 1 == seeded.DEGREE
    rng = random.Random(42)
    whole = [rng.getrandbits(32) for _ in range(200_000)]
    state = seeded.first_state(42)
    for steps in (0, 1, 623, 624, 1000, 79_999, 4 * seeded.DEGREE, 150_001):
        assert seeded.words(seeded.jumped(state, steps), 700).tolist() == whole[steps : steps + 700]
    # far away: two jumps are one
    far = seeded.jumped(seeded.jumped(state, 10**12), 10**12 + 7)
    assert seeded.words(far, 100).tolist() == seeded.words(seeded.jumped(state, 2 * 10**12 + 7), 100).tolist()


def drawn(frame):
    rows, block = frame
    out = {}
    for r in rows.collect():
        for place in np.frombuffer(r.places, "<i4").tolist():
            out.setdefault(r.sample, Counter())[r.block * block + place] += 1
    return out


@pytest.mark.parametrize(("n", "samples", "part"), [(1, 3, 1000), (2, 5, 8), (7, 40, 64), (1000, 9, 1500), (1024, 3, 1 << 24), (700, 2, 2)])
def test_draws(spark, monkeypatch, n, samples, part):
    monkeypatch.setattr(seeded, "BLOCK_CELLS", 900)
    rng = random.Random(5)
    want = {s: Counter(rng.randrange(n) for _ in range(n)) for s in range(samples)}
    assert drawn(seeded.draws(spark, n, samples, 5, part)) == want


def test_wide_numbers():
    rng = random.Random(3)
    assert seeded.numbers(3, 0, 40, 40).tolist() == [rng.getrandbits(40) for _ in range(20)]
    assert seeded.numbers(3, 1, 40, 40).tolist() == [rng.getrandbits(40) for _ in range(20)]


@pytest.mark.parametrize(("size", "part"), [(0, 50), (1, 50), (2, 37), (4, 61), (10, 1000), (10, 1 << 24), (5, 1)])
def test_orders(spark, size, part):
    rng, want = random.Random(8), {}
    for pos in range(60 if part > 1 else 8):
        order = list(range(size))
        rng.shuffle(order)
        want[pos] = order
    assert {r.pos: list(r.order) for r in seeded.orders(spark, len(want), size, 8, part).collect()} == want
