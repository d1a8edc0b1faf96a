"""Periodic runs of words within a document, by the linear tandem-repeat method of Gusfield and Stoye.

1. The text is cut into Lempel-Ziv blocks. Squares (a string twice in a row) whose first occurrence in the text reaches over a
   block's border are found by extending both ways from the border, for every possible period; they cover all squares leftmost.
2. From each of them a walk along suffix links turns the square by one word at a time and stops where the turned square doesn't
   occur or is known: the vocabulary of all squares is complete then.
3. All occurrences of each square are the leaves below its place in the suffix tree. Consecutive starts of squares of one period
   merge into a run.

The suffix tree is held as a suffix array with common-prefix lengths, in which a place in the tree is an interval; the names of
all factors of a power of two in length, from which it is sorted, also say how far two places agree. Only squares that are no
powers themselves are followed, so there are O(n log n) occurrences. The strings of a batch of documents share one array, and
words of different documents differ; a task does the same steps for all of them at once.

A word of a run with three periods or more occurs three times in its document. So the strings are the stretches of words that
occur that often, as long as the shortest run at least; a run can't reach beyond its stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, documents, flat, tidy

#: Fixed values of the query's contract: a run is so many words long at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of stretches that are searched at a time.
SEARCHED = 1 << 20


class Factors:
    """Suffix array of several strings, and names of factors. of: number of each symbol's string, in ascending order."""

    def __init__(self, symbols: np.ndarray, of: np.ndarray):
        self.n = n = len(symbols)
        first = np.searchsorted(of, np.arange(int(of[-1]) + 2))
        self.end = first[of + 1]
        longest = int(np.diff(first).max())
        _, name = np.unique(of.astype(np.int64) * (int(symbols.max()) + 1) + symbols, return_inverse=True)
        self.names = [np.append(name.astype(np.int32), np.int32(-1))]
        size = 1
        while size < longest and int(name.max()) + 1 < n:
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(np.arange(n) + size < self.end)
            after[inside] = name[inside + size] + 1
            _, name = np.unique(name.astype(np.int64) * (n + 1) + after, return_inverse=True)
            self.names.append(np.append(name.astype(np.int32), np.int32(-1)))
            size *= 2
        # suffixes of one string that agree to its end are one and the same, so the last names are ranks
        self.rank = name.astype(np.int64)
        self.sa = np.argsort(self.rank, kind="stable")
        lcp = np.zeros(n, np.int32)
        lcp[1:] = self.ahead(self.sa[:-1], self.sa[1:])
        #: lows[j][x]: the least common prefix between suffix x - 1 and suffix x + 2^j - 1 in order
        self.lows = [lcp]
        while 2 << (len(self.lows) - 1) <= n:
            last, half = self.lows[-1], 1 << (len(self.lows) - 1)
            self.lows.append(np.minimum(last[:-half], last[half:]))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are equal; a != b. Names of what the string cuts short equal no other."""
        a, b = a.astype(np.int64, copy=True), b.astype(np.int64, copy=True)
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name = self.names[j]
            again = True
            while again:  # only the largest size can repeat
                same = (a < self.n) & (b < self.n) & (name[np.minimum(a, self.n)] == name[np.minimum(b, self.n)])
                step = same.astype(np.int64) << j
                a, b, out = a + step, b + step, out + step
                again = j == len(self.names) - 1 and bool(same.any())
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a and up to b, both included, are equal; a != b."""
        a, b = a.astype(np.int64, copy=True), b.astype(np.int64, copy=True)
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            name, size = self.names[j], 1 << j
            again = True
            while again:
                x, y = a - size + 1, b - size + 1
                ok = (x >= 0) & (y >= 0)
                same = ok & (name[np.maximum(x, 0)] == name[np.maximum(y, 0)])
                step = same.astype(np.int64) << j
                a, b, out = a - step, b - step, out + step
                again = j == len(self.names) - 1 and bool(same.any())
        return out

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in order of the suffixes that begin with the `depth` symbols at `at`."""
        lo = self.rank[at].copy()
        hi = lo.copy()
        for j in range(len(self.lows) - 1, -1, -1):
            low, size = self.lows[j], 1 << j
            # suffixes lo - size .. lo agree that far if the prefixes between them do: entries lo - size + 1 .. lo
            x = lo - size + 1
            ok = (x >= 1) & (low[np.clip(x, 0, len(low) - 1)] >= depth)
            lo = np.where(ok, lo - size, lo)
            x = hi + 1
            ok = (x < len(low)) & (low[np.minimum(x, len(low) - 1)] >= depth)
            hi = np.where(ok, hi + size, hi)
        return lo, hi

    def turned(self, at: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place where the `depth` symbols at `at` stand with `symbol` (a name of one symbol) behind them, or -1: the child
        of that place in the tree, by binary search."""
        lo, hi = self.interval(at, depth)
        last = hi.copy()
        name = self.names[0]

        def behind(x):
            p = self.sa[x]
            return np.where(p + depth < self.end[p], name[np.minimum(p + depth, self.n)], -1)

        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = behind(mid) < symbol
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return np.where((lo <= last) & (behind(lo) == symbol), self.sa[lo], -1)


def blocks(t: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the Lempel-Ziv blocks: the longest factor that begins earlier too, or one new symbol."""
    before, after, open_ = np.full(t.n, -1, np.int64), np.full(t.n, -1, np.int64), []
    left, right = before.tolist(), after.tolist()
    for x in t.sa.tolist():
        while open_ and open_[-1] > x:
            right[open_.pop()] = x
        if open_:
            left[x] = open_[-1]
        open_.append(x)
    size = np.ones(t.n, np.int64)
    every = np.arange(t.n)
    for other in (np.array(left), np.array(right)):
        some = np.flatnonzero(other >= 0)
        size[some] = np.maximum(size[some], t.ahead(every[some], other[some]))
    size, starts, i = size.tolist(), [], 0
    while i < t.n:
        starts.append(i)
        i += size[i]
    starts = np.array(starts)
    return starts, np.diff(np.append(starts, t.n))


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes a, b, ...: 0 a times, 1 b times ...; and 1..a, 1..b, ..."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def leftmost_squares(t: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares over the borders of blocks, which cover the first occurrence of every square."""
    starts, sizes = blocks(t)
    name, found = t.names[0], []
    # the period's end at the border behind the block, q before it
    row, k = _each(sizes)
    border = starts[row] + sizes[row]
    q = border - k
    some = np.flatnonzero(name[np.minimum(border, t.n)] == name[q])
    border, q, k = border[some], q[some], k[some]
    k1, k2 = t.ahead(border, q), t.behind(border - 1, q - 1)
    ok = k1 + k2 >= k
    found.append((np.maximum(q - k2, q - k + 1)[ok], k[ok]))
    # the block's first symbol in the left half, q in the right
    row, k = _each(sizes + np.append(sizes[1:], 0))
    h = starts[row]
    q = h + k
    some = np.flatnonzero((h > 0) & (q < t.n) & (name[h] == name[np.minimum(q, t.n)]) & (name[np.maximum(h - 1, 0)] == name[np.minimum(q - 1, t.n)]))
    h, q, k = h[some], q[some], k[some]
    k1, k2 = t.ahead(h, q), t.behind(h - 1, q - 1)
    ok = k1 + k2 >= k
    found.append((np.maximum(h - k2, h - k + 1)[ok], k[ok]))
    at, k = (np.concatenate(x) for x in zip(*found))
    return at, k


def no_power(t: Factors, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k symbols at `at` are no power of a shorter string; they stand twice there."""
    ok, rest, most = np.ones(len(at), bool), k.copy(), int(k.max(initial=1))
    p = 2
    while p <= most:
        by = np.flatnonzero(rest % p == 0)
        if len(by):
            d = k[by] // p
            ok[by] &= t.ahead(at[by], at[by] + d) < 2 * k[by] - d
            while len(by):
                rest[by] //= p
                by = by[rest[by] % p == 0]
            most = int(rest.max(initial=1))
        p += 1
        if p * p > most and most > 1:  # what is left are primes
            for d in np.unique(rest[rest > 1]).tolist():
                by = np.flatnonzero(rest == d)
                ok[by] &= t.ahead(at[by], at[by] + k[by] // d) < 2 * k[by] - k[by] // d
            break
    return ok


def vocabulary(t: Factors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squares that are no powers, each once: first place in order, last place, period."""
    at, k = leftmost_squares(t)
    ok = no_power(t, at, k)
    at, k = at[ok], k[ok]
    key = lambda lo, k: lo * np.int64(t.n + 1) + k
    known = np.zeros(0, np.int64)
    while len(at):
        # a square turns along its own occurrence as far as the period lasts
        spare = t.ahead(at, at + k) - k
        end, order = at + spare, np.lexsort((at, at + spare, k))
        at, k, spare, end = at[order], k[order], spare[order], end[order]
        once = np.append(True, (k[1:] != k[:-1]) | (end[1:] != end[:-1]))
        at, k, spare, end = at[once], k[once], spare[once], end[once]
        row, step = _each(spare + 1)
        all_at, all_k = at[row] + step - 1, k[row]
        lo, _ = t.interval(all_at, 2 * all_k)
        keys = key(lo, all_k)
        new = np.unique(keys)
        met = np.isin(keys, known)
        # who has come to a known square follows another's walk
        stopped = np.zeros(len(at), bool)
        np.logical_or.at(stopped, row, met)
        known = np.union1d(known, new)
        # over the end: the suffix link, and from there the word that the square began with
        end, k = end[~stopped], k[~stopped]
        at = t.turned(end + 1, 2 * k - 1, t.names[0][end].astype(np.int64))
        at, k = at[at >= 0], k[at >= 0]
    lo, k = known // (t.n + 1), known % (t.n + 1)
    _, hi = t.interval(t.sa[lo], 2 * k)
    return lo, hi, k


def runs_of(symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of two periods or more of strings that stand behind one another."""
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    t = Factors(symbols, of)
    lo, hi, k = vocabulary(t)
    row, step = _each(hi - lo + 1)
    at, k = t.sa[lo[row] + step - 1], k[row]
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    start, period = at[first], k[first]
    return start, at[last] - start + 2 * period, period


def stretches(ids: np.ndarray, words: int, times: int) -> list[tuple[int, int]]:
    """Where words that occur `times` times or more stand, `words` of them or more in a row."""
    if len(ids) < words:
        return []
    often = np.bincount(ids)[ids] >= times
    edge = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0]))))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= words]


def repeated(words: list[bytes], doc_id) -> list[bytes]:
    """Words of the query: one document in ten, by its id's checksum, repeats a stretch from some place on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


RESULT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_kept bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = pa.schema([
    *((c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_kept", pa.int64()),
    ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
])


def _row(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = words
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(kept), [{"start": a, "length": b, "period": c} for a, b, c in runs])


def _found(least_words: int, least_periods: int, change):
    def searched(held):
        """Rows of documents (id, words, word numbers, stretches)."""
        symbols = [ids[a:b] for _, _, ids, some in held for a, b in some]
        found: dict[int, list] = {}
        if symbols:
            spots = [(d, a) for d, (_, _, _, some) in enumerate(held) for a, _ in some]
            sizes = np.array([len(x) for x in symbols])
            of = np.repeat(np.arange(len(symbols)), sizes)
            begin = np.cumsum(sizes) - sizes
            start, length, period = runs_of(np.concatenate(symbols), of)
            long = (length >= least_words) & (length >= least_periods * period)
            for s, n, q in zip(start[long].tolist(), length[long].tolist(), period[long].tolist()):
                d, a = spots[of[s]]
                found.setdefault(d, []).append((s - int(begin[of[s]]) + a, n, q))
        rows = [_row(doc_id, words, sorted(found.get(d, []), key=lambda r: (r[0], r[2]))) for d, (doc_id, words, _, _) in enumerate(held)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    def run(batches):
        for batch in batches:
            raw, at = flat(batch.column(1))
            held, size = [], 0
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                words = raw[at[k] : at[k + 1]].tobytes().split()
                if change is not None:
                    words = change(words, doc_id)
                seen: dict[bytes, int] = {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                some = stretches(ids, least_words, least_periods)
                held.append((doc_id, words, ids if some else None, some))
                size += sum(b - a for a, b in some)
                if size >= SEARCHED:
                    yield searched(held)
                    held, size = [], 0
            if held:
                yield searched(held)
        tidy()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, change=None) -> DataFrame:
    """One row per document: id, n_runs, the run of greatest length / period (start, length, period, exponent_milli; null where
    there is none), checksums of all runs and of the text without what runs repeat, n_words, n_kept and the runs themselves.

    Words are what ASCII white space separates. A run is as long as its period lasts, `least_words` words and `least_periods`
    (2 or more) periods at least. Null and empty texts have no words; their checksums are those of nothing. Repeated rows and
    ids give a row each, other columns are ignored. change(words, id) gives the words that are searched, if not the text's own.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_found(least_words, least_periods, change), RESULT)


def op12(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir, "doc_id", "text"), change=repeated)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
