"""Spelling variants by full neighbourhood generation.

Words are counted with built-in functions. Every vocabulary word emits all distinct strings that one deletion, replacement or
insertion over the observed alphabet makes of it; those that are words themselves, found by a hash join, are its near words,
and no distance is computed. A word has some 800 such strings, nearly all of them no word, so a task tests each one's rolling
hash against a filter of the vocabulary before it writes the string out. The filter has a fixed largest size; a vocabulary
beyond it is met in slices, one filter each. What passes by chance falls out in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents, mixed, saved

#: Fixed values of the query's contract: letters of a run, least length and count of a word, of how many runs one is garbled,
#: and how many times as frequent a form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, GARBLED, TIMES = r"[A-Za-zÀ-ÿ]", 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a filter holds, bits for each and places that a word sets.
SLICE_WORDS, WORD_BITS, SPOTS = 1 << 24, 16, 3
#: Strings that a task tests at a time.
TESTED = 1 << 20
BASE = 0x9E3779B97F4A7C15


def garbled_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word`, a row for each letter run: lower-cased (A-Z only), one in 31 by its checksum without one of its letters, and at
    least 7 long after that. A null text has no runs; a null id counts as the empty text."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), 1)).alias("w")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run)
    rows = rows.select("id", F.when(F.col("w").rlike("[A-Z]"), F.translate("w", UPPER, LOWER)).otherwise(F.col("w")).alias("w"))
    rows = rows.select("w", F.crc32(F.concat_ws(":", "id", "w").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), gone), F.substring(F.col("w"), gone + 2, F.length("w")))
    return rows.select(F.when(F.col("h") % GARBLED == 0, cut).otherwise(F.col("w")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


class Alphabet:
    """Code points and a random odd number for each, the same in every task."""

    def __init__(self, letters: list[str]):
        self.points = np.array(sorted(map(ord, letters)), np.uint32)
        self.values = mixed(self.points.astype(np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)

    def coded(self, words: list[str], size: int) -> np.ndarray:
        """Places in the alphabet, a row for each word of `size` letters."""
        return np.searchsorted(self.points, np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _spots(hashes: np.ndarray, bits: int):
    """Places of a hash in a filter, one array for each of SPOTS; bits is a power of two."""
    h = mixed(hashes)
    step = (h >> np.uint64(40)) | np.uint64(1)
    for _ in range(SPOTS):
        yield h & np.uint64(bits - 1)
        h = h + step


def _by_length(words: list[str]) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for w in words:
        found.setdefault(len(w), []).append(w)
    return found


def _hash_of(code: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    return (alphabet.values[code] * _powers(code.shape[1])[::-1]).sum(1, dtype=np.uint64)


def filter_of(words: DataFrame, alphabet: Alphabet, bits: int) -> np.ndarray:
    """The filter of a word column, as bytes; tasks combine what they set before it moves."""

    def run(batches):
        for batch in batches:
            at = [s for size, some in _by_length(batch.column(0).to_pylist()).items() for s in _spots(_hash_of(alphabet.coded(some, size), alphabet), bits)]
            if at:
                at = np.unique(np.concatenate(at))
                w, first = np.unique(at >> np.uint64(6), return_index=True)
                v = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(v.view(np.int64))], names=["w", "v"])

    table = words.mapInArrow(run, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("w").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def neighbours(words: list[str], alphabet: Alphabet, keep=None):
    """For words of one length: (places in `words`, strings) of all distinct strings one edit away. keep(hashes) says which
    ones to write out, by default all."""
    size = len(words[0])
    code = alphabet.coded(words, size)
    letters, n = len(alphabet.points), len(words)
    power, value = _powers(size + 2), alphabet.values
    own = value[code]
    head = np.zeros((n, size + 1), np.uint64)
    tail = np.zeros((n, size + 1), np.uint64)
    for i in range(size):
        head[:, i + 1] = head[:, i] * np.uint64(BASE) + own[:, i]
        tail[:, size - 1 - i] = tail[:, size - i] + own[:, size - 1 - i] * power[i]
    place = np.arange(size)
    # a letter of a stretch of equal ones is deleted once, and inserted once: before none that equals it
    cut = head[:, :-1] * power[size - 1 - place] + tail[:, 1:]
    once = np.ones((n, size), bool)
    once[:, 1:] = code[:, 1:] != code[:, :-1]
    changed = (head[:, :-1] * power[size - place] + tail[:, 1:])[:, :, None] + value[None, None, :] * power[size - 1 - place][None, :, None]
    other = code[:, :, None] != np.arange(letters)
    spot = np.arange(size + 1)
    longer = (head * power[size + 1 - spot] + tail)[:, :, None] + value[None, None, :] * power[size - spot][None, :, None]
    fresh = np.ones((n, size + 1, letters), bool)
    fresh[:, :-1] = other
    for kind, hashes, allowed in (("cut", cut, once), ("changed", changed, other), ("longer", longer, fresh)):
        if keep is not None:
            allowed = allowed.copy()
            allowed[allowed] = keep(hashes[allowed])
        at = np.nonzero(allowed)
        if not len(at[0]):
            continue
        base, i = code[at[0]], at[1][:, None]
        width = {"cut": size - 1, "changed": size, "longer": size + 1}[kind]
        col = np.arange(width)
        if kind == "cut":
            new = np.take_along_axis(base, col + (col >= i), 1)
        elif kind == "changed":
            new = np.where(col == i, at[2][:, None], base)
        else:
            new = np.where(col == i, at[2][:, None], np.take_along_axis(base, np.minimum(col - (col > i), size - 1), 1))
        if width:
            yield at[0], np.ascontiguousarray(alphabet.points[new]).view(f"<U{width}").ravel()
        else:
            yield at[0], np.full(len(at[0]), "")


def _emitted(alphabet: Alphabet, filter_, bits: int):
    schema = pa.schema([("word", pa.string()), ("near", pa.string())])

    def run(batches):
        held = filter_.value

        def keep(hashes):
            ok = np.ones(len(hashes), bool)
            left = np.arange(len(hashes))
            for spot in _spots(hashes, bits):
                spot = spot[left]
                hit = (held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                ok[left[~hit]] = False
                left = left[hit]
            return ok

        for batch in batches:
            for size, some in _by_length(batch.column(0).to_pylist()).items():
                step = max(1, TESTED // (2 * (size + 1) * len(alphabet.points)))
                for i in range(0, len(some), step):
                    part = some[i : i + step]
                    names = np.array(part, object)
                    for at, new in neighbours(part, alphabet, keep):
                        yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.string()), pa.array(new.tolist(), pa.string())], schema=schema)

    return run


def near_words(vocabulary: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, near: each pair of words of the column `word` (distinct, not null) one edit apart, in both directions."""
    spark = vocabulary.sparkSession
    letters = [r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()]
    n = vocabulary.count()
    if not letters:
        return vocabulary.select("word", F.col("word").alias("near")).limit(0)
    alphabet, slices = Alphabet(letters), max(1, -(-n // slice_words))
    out = None
    for k in range(slices):
        part = vocabulary.select("word").where(F.pmod(F.xxhash64("word"), F.lit(slices)) == k) if slices > 1 else vocabulary.select("word")
        bits = 1 << 10
        while bits < WORD_BITS * min(n, slice_words):
            bits <<= 1
        filter_ = spark.sparkContext.broadcast(filter_of(part, alphabet, bits))
        found = vocabulary.select("word").mapInArrow(_emitted(alphabet, filter_, bits), "word string, near string")
        found = found.join(part.withColumnRenamed("word", "near"), "near").select("word", "near")
        if slices > 1:
            found = saved(found)
        out = found if out is None else out.unionByName(found)
    return out


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms followed to the last, the way that is known doubled by each join. A form is at
    least ten times as frequent as its word, so ways are short and have no loops."""
    known = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known_next = saved(known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = known_next.select("word", "root")
        if known_next.where("moved").isEmpty():
            return known


def variants(words: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n over the occurrences in the column `word`.

    Null words are left out; repeated rows are occurrences. Two words are near if one insertion, deletion or replacement of a
    code point makes one of the other. A word's form is its near word of largest n, of ties the smallest in code-point order,
    if that n is at least `times` the word's; root follows forms to the last. An empty table gives an empty result.
    """
    spread = words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    vocabulary = saved(spread)
    near = near_words(vocabulary, slice_words).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    rows = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.lit(times) * F.col("n")
    rows = vocabulary.join(rows, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    rows = saved(rows)
    roots = rooted(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    return variants(garbled_runs(documents(spark, sf_dir, "doc_id", "text")))
