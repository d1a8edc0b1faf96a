"""The stream of one seeded generator, made in parts: a task jumps to its part and makes that part only.

The generator (MT19937, as `random.Random` seeds and reads it) is linear over two elements: the words it makes satisfy one
recurrence whose polynomial has degree 19,937. So the state after J words is the sum of those of the next 19,937 words that x^J
has left when divided by that polynomial. A number below n takes the first that fits among numbers of n's bits; how many words
that takes is known only from the words, so parts are counted first and placed by prefix sums.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE, MIDDLE, DEGREE = 624, 397, 19937
#: Words of a part, and positions times samples that a task holds of one block.
PART_WORDS, BLOCK_CELLS = 1 << 24, 1 << 22


def first_state(seed: int) -> np.ndarray:
    return np.array(random.Random(seed).getstate()[1][:-1], np.uint32)


def _untempered(state: np.ndarray, n: int) -> np.ndarray:
    """The state's words and those that follow, n in all."""
    out = np.empty(n, np.uint32)
    out[:STATE] = state
    at, step = STATE, STATE - MIDDLE
    while at < n:
        m = min(step, n - at)
        low = out[at - STATE + 1 : at - STATE + 1 + m]
        both = (out[at - STATE : at - STATE + m] & np.uint32(0x80000000)) | (low & np.uint32(0x7FFFFFFF))
        out[at : at + m] = out[at - STATE + MIDDLE : at - STATE + MIDDLE + m] ^ (both >> np.uint32(1)) ^ ((both & np.uint32(1)) * np.uint32(0x9908B0DF))
        at += m
    return out


@functools.cache
def polynomial() -> int:
    """The recurrence's polynomial, bit i for x^i: the shortest one that the lowest bits of the words satisfy."""
    bits = (_untempered(first_state(1), STATE + 2 * DEGREE + 64)[STATE:] & np.uint32(1)).tolist()
    # Berlekamp and Massey over bits; `seen` has the bits so far, the newest lowest
    now, before, length, since, seen = 1, 1, 0, 1, 0
    for k, bit in enumerate(bits):
        seen = (seen << 1) | bit
        if (now & seen).bit_count() & 1:
            if 2 * length <= k:
                now, before, length, since = now ^ (before << since), now, k + 1 - length, 1
                continue
            now ^= before << since
        since += 1
    # `now` has the coefficient of the word i back at bit i; turned round it is that of x^(length - i)
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


_SPREAD = [int("".join(f"0{b}" for b in f"{i:08b}"), 2).to_bytes(2, "little") for i in range(256)]


def _remainder(a: int, by: int) -> int:
    degree = by.bit_length() - 1
    while (over := a.bit_length() - 1 - degree) >= 0:
        a ^= by << over
    return a


def power(steps: int) -> int:
    """x^steps divided by the polynomial: what is left."""
    by, out = polynomial(), 1
    for bit in bin(steps)[2:]:
        squared = b"".join(_SPREAD[x] for x in out.to_bytes((out.bit_length() + 7) // 8, "little"))
        out = int.from_bytes(squared, "little") << (bit == "1")
        out = _remainder(out, by)
    return out


def jumped(state: np.ndarray, steps: int) -> np.ndarray:
    """The state after so many words."""
    if steps < 4 * DEGREE:
        return _untempered(state, STATE + steps)[steps:]
    left = power(steps)
    ahead = np.lib.stride_tricks.sliding_window_view(_untempered(state, DEGREE + STATE), STATE)
    bits = np.unpackbits(np.frombuffer(left.to_bytes((DEGREE + 7) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.bitwise_xor.reduce(ahead[np.flatnonzero(bits[:DEGREE])], axis=0)


def words(state: np.ndarray, n: int) -> np.ndarray:
    """The next n words as the generator gives them."""
    made = np.random.MT19937()
    made.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": STATE}}
    return made.random_raw(n).astype(np.uint32)


def numbers(seed: int, part: int, part_words: int, bits: int) -> np.ndarray:
    """Numbers of so many bits, 1 to 64, that a part of the stream has. The words of one number are not cut apart."""
    got = words(jumped(first_state(seed), part * part_words), part_words)
    if bits <= 32:
        return (got >> np.uint32(32 - bits)).astype(np.int64)
    return (got[::2].astype(np.uint64) | ((got[1::2] >> np.uint32(64 - bits)).astype(np.uint64) << np.uint64(32))).astype(np.int64)


def _parts(spark: SparkSession, first: int, n: int) -> DataFrame:
    return spark.range(first, first + n, 1, min(n, 4096)).withColumnRenamed("id", "part")


def draws(spark: SparkSession, n: int, samples: int, seed: int, part_words: int = PART_WORDS) -> tuple[DataFrame, int]:
    """What `samples` times n draws of random.Random(seed).randrange(n) give: rows (block, sample, places), places being those of
    the positions in a block of so many (the second result), as packed 32-bit integers. The stream is made in parts."""
    if n < 1 or n.bit_length() > 62:
        raise ValueError("1 to 2^62 positions")
    bits, wanted, block = n.bit_length(), n * samples, max(1, min(n, BLOCK_CELLS // samples))
    per = 1 if bits <= 32 else 2
    part_words = min(part_words, 2 * STATE * (1 + (per * 4 * wanted) // (2 * STATE)))
    part_words += part_words % 2

    def fitting(part: int) -> np.ndarray:
        got = numbers(seed, part, part_words, bits)
        return got[got < n]

    def counted(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(fitting(part))], pa.int64())], names=["part", "n"])

    counts: list[int] = []
    while sum(counts) < wanted:
        missing = (wanted - sum(counts)) * per * 2**bits // n
        more = _parts(spark, len(counts), 1 + int(missing * 1.001) // part_words)
        counts += [r["n"] for r in sorted(more.mapInArrow(counted, "part bigint, n bigint").collect())]
    starts = np.cumsum([0, *counts]).tolist()

    def placed(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                at = starts[part]
                got = fitting(part)[: max(0, wanted - at)]
                while len(got):
                    sample, room = at // n, n - at % n
                    some, got = np.sort(got[:room]), got[room:]
                    at += len(some)
                    blocks, first = np.unique(some // block, return_index=True)
                    ends = [*first[1:].tolist(), len(some)]
                    rows = [(some[a:b] - k * block).astype("<i4").tobytes() for k, a, b in zip(blocks.tolist(), first.tolist(), ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([sample] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["block", "sample", "places"])

    return _parts(spark, 0, len(counts)).mapInArrow(placed, "block bigint, sample int, places binary"), block


def orders(spark: SparkSession, items: int, size: int, seed: int, part_words: int = PART_WORDS >> 4) -> DataFrame:
    """pos, order: what random.Random(seed).shuffle(list(range(size))) makes of `items` lists, one after the other.

    A list takes size - 1 numbers, below size, size - 1, ... 2. Where a part begins within a list depends on the parts before it,
    but there are only size - 1 ways to begin: each part is counted for all of them, and the ways are followed from part to part.
    """
    bounds = list(range(size, 1, -1))
    if not bounds or not items:
        return spark.range(items).selectExpr("id AS pos", f"sequence(0, {size - 1}) AS order" if size else "array() AS order")
    wanted = items * len(bounds)
    part_words = min(part_words, STATE * (1 + (4 * wanted) // STATE))

    def taken(got: np.ndarray, phase: int, most: int | None = None) -> list[int]:
        """Numbers that a part gives to a list's draws from `phase` on."""
        shift = [32 - b.bit_length() for b in bounds]
        out, m = [], len(bounds)
        for w in got.tolist():
            r = w >> shift[phase]
            if r < bounds[phase]:
                out.append(r)
                phase = phase + 1 if phase + 1 < m else 0
                if len(out) == most:
                    break
        return out

    def stream(part: int) -> np.ndarray:
        return words(jumped(first_state(seed), part * part_words), part_words)

    def counted(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                got = stream(part)
                ways = [len(taken(got, p)) for p in range(len(bounds))] if part else [len(taken(got, 0))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([ways], pa.list_(pa.int64()))], names=["part", "ways"])

    starts, parts = [0], 0
    while starts[-1] < wanted:
        need = sum(2 ** b.bit_length() / b for b in bounds) / len(bounds) * (wanted - starts[-1])
        more = 1 + int(need * 1.001) // part_words
        for r in sorted(_parts(spark, parts, more).mapInArrow(counted, "part bigint, ways array<bigint>").collect()):
            starts.append(starts[-1] + r["ways"][starts[-1] % len(bounds)])
        parts += more

    def placed(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                at = starts[part]
                if at < wanted:
                    got = np.array(taken(stream(part), at % len(bounds), wanted - at), np.int32)
                    place = at + np.arange(len(got))
                    yield pa.RecordBatch.from_arrays([pa.array(place // len(bounds), pa.int64()), pa.array((place % len(bounds)).astype(np.int32)), pa.array(got)], names=["pos", "k", "r"])

    drawn = _parts(spark, 0, parts).mapInArrow(placed, "pos bigint, k int, r int")

    def shuffled(batches):
        for batch in batches:
            out = []
            for numbers_ in batch.column(1).to_pylist():
                order = list(range(size))
                for b, r in zip(bounds, numbers_):
                    order[b - 1], order[r] = order[r], order[b - 1]
                out.append(order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["pos", "order"])

    listed = drawn.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("k", "r")))["r"].alias("numbers"))
    return listed.mapInArrow(shuffled, "pos bigint, order array<int>")

