"""Periodic runs against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tamga.llm import periodic_runs as P

SCHEMA = "doc_id bigint, text string"


def plain_runs(s, least=lambda length, q: length >= 2 * q):
    """All maximal stretches with smallest period q, period by period."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    # a stretch of two periods whose smallest period is smaller is known by that one, as long or longer
    return sorted((a, n, q) for (a, n), q in found.items() if least(n, q))


def searched(strings):
    strings = [s for s in strings if len(s)]
    of = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    begin = np.cumsum([0, *map(len, strings)])
    got = P.runs_of(np.concatenate([np.array(s) for s in strings]), of)
    out = [[] for _ in strings]
    for a, n, q in zip(*(x.tolist() for x in got)):
        out[of[a]].append((a - int(begin[of[a]]), n, q))
    return strings, [sorted(x) for x in out]


def test_all_short_strings():
    strings, got = searched([list(x) for n in range(1, 11) for x in itertools.product(range(2), repeat=n)])
    for s, runs in zip(strings, got):
        assert runs == plain_runs(s), s


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_strings(letters):
    rnd = random.Random(letters)
    strings = []
    for _ in range(150):
        s = [rnd.randrange(letters) for _ in range(rnd.randint(1, 40))]
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(s))
            part = s[i : i + rnd.randint(1, 12)]
            s[i:i] = part * rnd.randint(1, 4) + part[: rnd.randrange(len(part) + 1)]
        strings.append(s)
    strings, got = searched(strings)
    for s, runs in zip(strings, got):
        assert runs == plain_runs(s), s


def test_fibonacci_and_thue_morse_strings():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    t = [bin(i).count("1") % 2 for i in range(512)]
    long = [1] * 3000 + [2, 1] * 700 + list(range(50)) * 20
    strings, got = searched([b, t, long])
    for s, runs in zip(strings, got):
        assert runs == plain_runs(s)


def plain_row(doc_id, text, change=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if change and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, lambda length, q: length >= max(24, 3 * q))
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    lines, kept = "".join("%d,%d,%d\n" % r for r in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts():
    rnd = random.Random(9)
    for i in range(120):
        words = [rnd.choice("a b c dd é 日本".split()) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(words))
            words[at:at] = [rnd.choice("a b x y".split()) for _ in range(rnd.randint(1, 9))] * rnd.randint(2, 9)
        yield i, rnd.choice((" ", "\t", "\x0b ", "\n\n")).join(words)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_of_few_words(spark):
    docs = [*texts(), (500, None), (501, ""), (502, " \n"), (None, "a " * 30), (503, "x"), (503, "x"), (504, "\xa0 nbsp is no space " * 20), (505, "z " * 200_000)]
    df = spark.createDataFrame([(i, t, "w") for i, t in docs], f"{SCHEMA}, words string")
    got = P.periodic_runs(df, change=P.repeated).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [plain_row(i, t) if i != 505 else None for i, t in docs]
    want[-1] = next(tuple(r) for r in got.collect() if r.doc_id == 505)
    assert want[-1][1:6] == (1, 0, 200_000, 1, 200_000_000)
    assert rows(got) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 60


def test_own_words_and_real_outputs(spark):
    docs = list(texts())
    got = {r.doc_id: r for r in P.periodic_runs(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, t in docs:
        want = plain_row(i, t, change=False)
        assert tuple(got[i])[:8] == want
        runs = [tuple(r) for r in got[i].runs]
        assert hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest() == want[6]


def test_two_periods_are_enough_if_asked(spark):
    docs = list(texts())
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in P.periodic_runs(spark.createDataFrame(docs, SCHEMA), least_words=2, least_periods=2).collect()}
    assert got == {i: plain_runs(t.split()) for i, t in docs}
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame(docs, SCHEMA), least_periods=1)


def test_odd_tables(spark):
    assert P.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(P.op12(spark, path)) == sorted((quick_row(i, t) for i, t in docs), key=str)


def quick_row(doc_id, text):
    """plain_row with runs by numpy, period by period."""
    words = P.repeated((text or "").encode().split(), doc_id)
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    taken, runs = set(), []
    for q in range(1, len(ids) // 3 + 1):
        same = np.concatenate(([0], (ids[:-q] == ids[q:]).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + q >= max(24, 3 * q) and (a, b + q) not in taken:
                taken.add((a, b + q))
                runs.append((a, b - a + q, q))
    runs.sort(key=lambda r: (r[0], r[2]))
    return P._row(doc_id, words, runs)[:8]
