"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tamga.llm import spelling

UP = str.maketrans(spelling.UPPER, spelling.LOWER)
SCHEMA = "doc_id bigint, text string"


def plain_words(docs):
    found = []
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UP)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                found.append(w)
    return found


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    n = {w: c for w, c in Counter(words).items() if c >= 2}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_size.get(len(w) + d, []) if one_apart(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def said(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_neighbours_are_all_strings_one_edit_away():
    letters = list("abé")
    alphabet = spelling.Alphabet(letters)
    for word in ("a", "ab", "aab", "aaaa", "abéab"):
        got = [x for _, new in spelling.neighbours([word], alphabet) for x in new.tolist()]
        cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
        other = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} - {word}
        longer = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        assert sorted(got) == sorted(cut | other | longer)


def test_neighbour_hashes_are_those_of_the_strings():
    alphabet = spelling.Alphabet(list("abcd"))
    seen = []
    words = ["abcabca", "aaaaaaa", "ddabcda"]
    strings = [x for _, new in spelling.neighbours(words, alphabet, lambda h: seen.append(h) or [True] * len(h)) for x in new.tolist()]
    hashes = [h for part in seen for h in part.tolist()]
    assert hashes == [int(spelling._hash_of(alphabet.coded([s], len(s)), alphabet)[0]) for s in strings]


@pytest.mark.parametrize("slice_words", [spelling.SLICE_WORDS, 50])
def test_random_words(spark, slice_words):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    words = []
    for k, s in enumerate(stems):
        words += [s] * (1 + k * k // 3)
        for _ in range(6):
            i = rnd.randint(0, len(s))
            words += [rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abcé") + s[i:], s[:i] + "é" + s[i + 1 :]])] * rnd.randint(1, 12)
    words = [w for w in words if len(w) >= 7]
    rnd.shuffle(words)
    got = said(spelling.variants(spark.createDataFrame([(w,) for w in words], "word string"), slice_words=slice_words))
    want = plain_variants(words)
    assert got == want
    assert any(r[0] for r in want.values()) and any(r[3] > 2 for r in want.values())


def test_long_way_to_the_root(spark):
    # each form is ten times as frequent and one letter on: a way of four steps
    words = [w for k, n in enumerate((2, 20, 200, 2000, 20000)) for w in ["b" * k + "a" * (9 - k)] * n]
    got = said(spelling.variants(spark.createDataFrame([(w,) for w in words], "word string")))
    assert {r[1] for r in got.values()} == {"bbbbaaaaa"} and got == plain_variants(words)


def test_ties_go_to_the_first_in_code_point_order(spark):
    words = ["grüsse" + c for c in "zaÿ" for _ in range(20)] + ["grüssex"] * 2
    got = said(spelling.variants(spark.createDataFrame([(w,) for w in words], "word string")))
    assert got["grüssex"] == ("grüssea", "grüssea", 2, 3, 20) and got == plain_variants(words)


def test_runs_are_garbled_by_their_checksum(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join("".join(rnd.choice("abcDEFÀÿ÷") for _ in range(rnd.randint(5, 9))) for _ in range(40)) + "1x_longrun-Āotherrun") for i in range(30)]
    docs += [(7, None), (8, ""), (None, "nullidentifier word"), (3, "Repeated repeated"), (3, "Repeated repeated"), (99, "ab" * 30000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], f"{SCHEMA}, word string")
    got = Counter(r.word for r in spelling.garbled_runs(df).collect())
    want = plain_words(docs)
    assert got == Counter(want)
    lowered = [r.translate(UP) for _, t in docs for r in re.findall("[A-Za-zÀ-ÿ]{7,}", t or "")]
    assert Counter(want) != Counter(lowered)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.garbled_runs(empty)).collect() == []
    once = spark.createDataFrame([("seldom seen",), (None,)], "word string")
    assert spelling.variants(once).collect() == []
    twice = spark.createDataFrame([("abcdefg",), ("abcdefg",), (None,), (None,)], "word string")
    assert said(spelling.variants(twice)) == {"abcdefg": (None, "abcdefg", 2, 0, None)}


def test_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert said(spelling.op13(spark, path)) == plain_variants(plain_words(docs))
