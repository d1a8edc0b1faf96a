"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound as rot2(a) * rot1(b) * c, where rot is a
permutation of the positions (a rotation); a text is the bundle (sum) of its trigrams, a language the bundle of its
training texts, and the nearest language by cosine wins. Training bundles are additive, so trigram counts per language are
summed over the whole training part first and bound once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, documents, flat, free_name, mixed, slices, tidy

DIM, SEED = 1024, 20240229
#: Bundled trigram vectors, and letters' vectors, that a worker keeps.
HELD, HELD_LETTERS = 24_000, 8192
SLICE = 1 << 18
#: Trigram vectors that are added up at once; counts that a task holds before it hands them on.
PART, COUNTS = 2048, 1 << 20
#: Bits of a code point within a trigram's number.
POINT = 21


@functools.cache
def _alphabet() -> np.ndarray:
    """Code point -> its letter in lower case, as a code point; 0: no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each letter, from hashes of its code point: any number of letters, each its own."""
    words = mixed(points.astype(np.uint64)[:, None] * np.uint64(DIM) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED << 32))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(points), DIM // 8), axis=1, bitorder="little")
    vectors = bits.astype(np.int8) * 2 - 1
    vectors[points == 0] = _BORDER
    return vectors


_BORDER = np.random.default_rng(SEED).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


class _Letters:
    """Vectors of the letters that were met, in their three rotations."""

    def __init__(self):
        self.place, self.n, self.vectors = np.full(0x110000, -1, np.int32), 0, np.zeros((3, 64, DIM), np.int8)

    def places(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.place[points] < 0])
        if len(new):
            if self.n + len(new) > HELD_LETTERS:
                self.place[:], self.n = -1, 0
                new = np.unique(points)
            if (need := self.n + len(new)) > self.vectors.shape[1]:
                self.vectors = np.concatenate([self.vectors, np.zeros((3, max(need, 2 * self.n) - self.vectors.shape[1], DIM), np.int8)], 1)
            made = letter_vectors(new)
            for turn in range(3):
                self.vectors[turn, self.n : need] = np.roll(made, turn, 1)
            self.place[new] = np.arange(self.n, need, dtype=np.int32)
            self.n = need
        return self.place[points]


@functools.cache
def _letters() -> _Letters:
    return _Letters()


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, numbers of three code points. At most HELD_LETTERS of them at a time have all their letters held."""
    mask, held = (1 << POINT) - 1, _letters()
    out = np.empty((len(grams), DIM), np.int8)
    for i in range(0, len(grams), HELD_LETTERS // 3):
        part = grams[i : i + HELD_LETTERS // 3]
        a, b, c = held.places(np.concatenate([part >> 2 * POINT, (part >> POINT) & mask, part & mask])).reshape(3, -1)
        out[i : i + len(part)] = held.vectors[2][a] * held.vectors[1][b] * held.vectors[0][c]
    return out


class _Bundler:
    def __init__(self):
        self.known, self.slot, self.n, self.vectors = np.zeros(0, np.int64), np.zeros(0, np.int32), 0, np.zeros((1024, DIM), np.int8)

    def slots(self, grams: np.ndarray) -> np.ndarray:
        """grams: distinct, in order, HELD of them at most."""
        at = np.searchsorted(self.known, grams)
        has = np.zeros(len(grams), bool)
        inside = at < len(self.known)
        has[inside] = self.known[at[inside]] == grams[inside]
        if not has.all():
            if self.n + int((~has).sum()) > HELD:
                self.known, self.slot, self.n, at = self.known[:0], self.slot[:0], 0, np.zeros(len(grams), np.int64)
                has[:] = False
            new = grams[~has]
            if (need := self.n + len(new)) > len(self.vectors):
                self.vectors = np.vstack([self.vectors, np.zeros((max(need, 2 * len(self.vectors)) - len(self.vectors), DIM), np.int8)])
            self.vectors[self.n : need] = bound(new)
            self.known, self.slot = np.insert(self.known, at[~has], new), np.insert(self.slot, at[~has], np.arange(self.n, need, dtype=np.int32))
            self.n = need
        return self.slot[np.searchsorted(self.known, grams)]


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, trigrams (numbers of three code points) and how often each occurs in its row, in order of rows. Runs of characters
    that are no letters are one boundary."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    n = len(at) - 1
    symbols, rows = np.zeros(len(points) + n + 1, np.uint32), np.repeat(np.arange(n), np.diff(starts))
    symbols[np.arange(len(points)) + rows + 1] = _alphabet()[points]
    row_of = np.zeros(len(symbols), np.int32)
    row_of[np.arange(len(points)) + rows + 1] = rows
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[0] = True
    symbols, row_of = symbols[keep], row_of[keep]
    if symbols[-1]:
        symbols, row_of = np.append(symbols, np.uint32(0)), np.append(row_of, 0)
    mid = np.flatnonzero(symbols)
    # letters by their number among those that occur here, so that row and trigram fit one number
    letters = np.flatnonzero(np.bincount(symbols, minlength=1)).astype(np.int64)
    small = np.zeros(int(letters[-1]) + 1, np.int64)
    small[letters] = np.arange(len(letters))
    local, size = small[symbols], len(letters)
    gram = (local[mid - 1] * size + local[mid]) * size + local[mid + 1]
    if size**3 * n < 1 << 62:
        keys, times = np.unique(row_of[mid] * np.int64(size**3) + gram, return_counts=True)
        row, gram = keys // size**3, keys % size**3
    else:
        some, back = np.unique(gram, return_inverse=True)
        keys, times = np.unique((row_of[mid].astype(np.int64) << 32) | back, return_counts=True)
        row, gram = keys >> 32, some[keys & 0xFFFFFFFF]
    return row, (letters[gram // size**2] << 2 * POINT) | (letters[gram // size % size] << POINT) | letters[gram % size], times


def _counted(batches):
    held: dict[str, list] = {}

    def handed():
        for name, parts in held.items():
            grams, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            some, back = np.unique(grams, return_inverse=True)
            sums = np.bincount(back, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(sums)], names=["lang", "gram", "n"])
        held.clear()

    size = 0
    for batch in batches:
        raw, at = flat(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j in slices(at, SLICE):
            rows, grams, n = trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            names, which = np.unique(langs[i:j].astype(str), return_inverse=True)
            for k, name in enumerate(names):
                mine = which[rows] == k
                some, back = np.unique(grams[mine], return_inverse=True)
                if len(some):
                    held.setdefault(name, []).append((some, np.bincount(back, n[mine])))
                    size += len(some)
        if size >= COUNTS:
            yield from handed()
            size = 0
        tidy()
    yield from handed()


def _bundled(batches):
    """Counts (lang, gram, n) -> the numbers of the languages' bundles."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names, which = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
        grams, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
        for k, name in enumerate(names):
            mine = np.flatnonzero(which == k)
            for i in range(0, len(mine), PART):
                part = mine[i : i + PART]
                sums[name] = sums.get(name, 0) + n[part] @ bound(grams[part]).astype(np.float64)
    for name, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], names=["lang", "i", "x"])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Language names and their unit prototypes; rows without text or language teach nothing.

    Trigrams are counted and bundled in tasks; what reaches the driver is one vector per language.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    counts = rows.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.mapInArrow(_bundled, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).toArrow()
    lang, i, x = (np.array(table.column(c).to_pylist()) for c in ("lang", "i", "x"))
    names, made = sorted(set(lang.tolist())), []
    for name in names:
        mine, total = lang == name, np.zeros(DIM)
        total[i[mine]] = x[mine]
        made.append(total / max(np.linalg.norm(total), 1e-9))
    return names, np.array(made, np.float32).reshape(len(names), DIM)


def _predictor(names: list[str], prototypes: np.ndarray):
    held: list[_Bundler] = []

    def predict(text: pa.Array) -> pa.Array:
        if not held:
            held.append(_Bundler())
        bundler = held[0]
        raw, at = flat(text)
        best, score = np.full(len(at) - 1, -1), np.zeros(len(at) - 1)
        for i, j in slices(at, SLICE) if names else ():
            rows, grams, n = trigrams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            if not len(rows):
                continue
            n = n.astype(np.float32)
            used, back = np.unique(grams, return_inverse=True)
            slots = bundler.slots(used)[back] if len(used) <= HELD else None
            cut = np.flatnonzero(np.diff(rows, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(rows)]):
                vector = np.zeros(DIM, np.float32)
                for c in range(a, b, PART):
                    d = min(c + PART, b)
                    vector += n[c:d] @ (bundler.vectors[slots[c:d]] if slots is not None else bound(grams[c:d])).astype(np.float32)
                near = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-9)
                best[i + rows[a]] = k = int(np.argmax(near))
                score[i + rows[a]] = min(1.0, max(0.0, float(near[k])))
        tidy()
        said = pa.array([names[k] if k >= 0 else "und" for k in best.tolist()], pa.string())
        return pa.StructArray.from_arrays([said, pa.array(score)], ["lang", "score"])

    # what is said to be nondeterministic is not worked out twice where it is both filtered by and kept
    return F.arrow_udf(predict, "lang string, score double").asNondeterministic()


def predicted(names: list[str], prototypes: np.ndarray, text: Column) -> Column:
    """struct<lang, score> of a text: the nearest language and its cosine. Null text or text without a letter: `und`, 0. Ties
    go to the first name. Where nothing was learnt every text is `und`."""
    return _predictor(names, prototypes)(text)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, see predicted(); columns of these names are replaced, others and repeated rows stay."""
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "said")
    got = docs.withColumn(name, predicted(names, prototypes, F.col(text_col)))
    return got.withColumn("lang_pred", F.col(name)["lang"]).withColumn("score", F.col(name)["score"]).drop(name)


def known(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents that resemble a language, with that language as their lang_col; all columns stay, and only that one changes.

    A document is rejected if it has no letter or its cosine with every language is 0 or less. If nothing was learnt, all
    documents with a letter stay as they are.
    """
    bounded_batches(docs.sparkSession)
    if not names:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    name = free_name(docs, "said")
    got = docs.withColumn(name, predicted(names, prototypes, F.col(text_col)))
    return got.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] > 0)).withColumn(lang_col, F.col(name)["lang"]).drop(name)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 1 by 3; a null id is not held out, and teaches nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    names, prototypes = trained(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), names, prototypes).select("doc_id", "held_out", "lang_pred", "score")
