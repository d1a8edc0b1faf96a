"""Removal of byte strings that a document with a smaller id already has, by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first DEPTH bytes only, most significant digit first, and a group with a single document
left is dropped at once. Groups that are equal after the last digit are exactly the repeated windows.

The first digit is spread over the cluster. It is the least hash among the GRAM-byte strings inside a window: equal windows
have equal digits, and neighbouring windows mostly share theirs, so a run of windows with one digit travels as one
fragment instead of window by window. The first pass moves digests of the bytes around that hash, no text, and keeps the windows
whose digest several documents have; the second moves the text of those, and within a bucket orders it by the window's bytes, eight at a time.
In both a task first sorts its own batch: windows that the batch itself repeats are settled there and never travel, so a
passage in very many documents reaches a bucket once per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import IdFilter, bounded_batches, documents, flat, mixed, packed, release, saved, stored_bytes, tidy, unpacked
from .exact_dedup import exact_duplicates

DEPTH, GRAM, SIDE = 50, 16, 17
#: Text that a task sorts at once, and text that a bucket gets.
BATCH_BYTES, BUCKET_BYTES = 6 << 20, 1 << 20
#: Windows of one repeated byte that travel as one fragment.
CONSTANT = 200
#: Windows that a bucket orders at once.
PART = 1 << 20
#: Text whose windows a task looks at one by one.
SLICE = 1 << 19


def _u64(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", buffer=raw, strides=(1,))


def _digits(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the least gram hash inside the window, and how far into it the first such gram is."""
    eight = _u64(raw)
    least = (eight[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    least ^= least >> np.uint64(29)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    least ^= least >> np.uint64(32)
    far = np.zeros(len(least), np.uint8)
    width, have = DEPTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        far = np.where(later, far[step:] + np.uint8(step), far[:-step])
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least, far


def _sides(raw: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """24-bit digests of the gram with SIDE bytes before it, and with SIDE bytes after it. Each window holds one of the two."""
    eight, made = _u64(raw), []
    for places in ((-17, -9, -1, 7, 8), (0, 8, 16, 24, 25)):
        digest = np.zeros(len(anchor), np.uint64)
        for k in places:
            digest = (digest ^ eight[np.maximum(anchor + k, 0)]) * np.uint64(0x9FB21C651E98DF25)
            digest ^= digest >> np.uint64(31)
        made.append((mixed(digest) >> np.uint64(40)).astype("<u4"))
    return made[0], made[1]


def _heads(group: np.ndarray) -> np.ndarray:
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return new


def _mixed_docs(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of the groups (sorted) with more than one document."""
    at = np.flatnonzero(_heads(group))
    if not len(at):
        return np.zeros(0, bool)
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    return np.repeat(several, np.diff(np.append(at, len(group))))


def repeated(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows (raw[off : off + DEPTH] of document doc) also occur in a smaller document. group: first digit, any order."""
    eight = _u64(raw)
    key = (mixed(group) & np.uint64(0xFFFFFFF000000000)) | (mixed(eight[off]) >> np.uint64(28))
    order = np.argsort(key)
    # now equal windows are together; a later digit is sorted only where a group isn't of one kind yet
    spot = [*range(0, DEPTH - 7, 8)] + ([DEPTH - 8] if DEPTH % 8 else [])
    kind = np.cumsum(_heads(key[order]))
    for depth in spot:
        keep = _mixed_docs(kind, doc[order])
        order, kind = order[keep], kind[keep]
        if not len(order):
            break
        digit = eight[off[order] + depth]
        first = np.flatnonzero(_heads(kind))
        size = np.diff(np.append(first, len(kind)))
        if (differs := digit != np.repeat(digit[first], size)).any():
            loose = np.repeat(np.logical_or.reduceat(differs, first), size)
            at = np.flatnonzero(loose)
            again = np.lexsort((digit[at], kind[at]))
            order[at], digit[at] = order[at][again], digit[at][again]
        kind = np.cumsum(_heads(kind) | _heads(digit))
    out = np.zeros(len(off), bool)
    if len(order):
        first = np.flatnonzero(_heads(kind))
        owner = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(kind))))
        out[order] = doc[order] > owner
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, behind one another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def settle(raw: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments (n windows from raw[at] on, of document doc, sharing a first digit) -> fragment and window number of each
    window that a smaller document has. Fragments go through in parts, all of one digit in the same part."""
    order = np.argsort(digit)
    order = order[_mixed_docs(digit[order], doc[order])]
    got_f, got_w = [], []
    ends = np.cumsum(n[order])
    cuts = np.flatnonzero(_heads(digit[order]))
    i = 0
    while i < len(order):
        base = ends[i - 1] if i else 0
        j = np.searchsorted(ends, base + PART, "right")
        k = np.searchsorted(cuts, max(j, i + 1), "right") - 1
        j = int(cuts[k]) if cuts[k] > i else int(cuts[k + 1]) if k + 1 < len(cuts) else len(order)
        if ends[-1] - base <= PART:
            j = len(order)
        part = order[i:j]
        frag = np.repeat(part, n[part])
        off = _ranges(at[part], n[part])
        hit = repeated(raw, off, doc[frag], digit[frag])
        got_f.append(frag[hit])
        got_w.append(off[hit] - at[frag[hit]])
        i = j
    if not got_f:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(got_f), np.concatenate(got_w)


def _spans(key: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (into key order), starts and ends of the byte runs that windows of one key cover."""
    order = np.lexsort((window, key))
    key, window = key[order], window[order]
    new = _heads(key)
    new[1:] |= window[1:] > window[:-1] + DEPTH
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return order[first], window[first], window[last] + DEPTH


ROW = "bucket int, block binary, id bigint, mark bigint, start bigint, end bigint"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _found(bucket, ids, marks, starts, ends):
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=_SCHEMA)


def _blocks(names, blocks):
    empty = pa.nulls(len(names), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary()), empty, empty, empty, empty], schema=_SCHEMA)


def _fragments(raw, at, rows, begin, count):
    """Runs of windows (from raw[begin] on, count many, of row) with one anchor: first window, count, row, anchor, digit.

    rows are sorted. Window by window things are held for a slice of the rows at a time. Each window of one repeated byte would
    be a run by itself; they are all equal, whatever stands around them, so up to CONSTANT of them share the anchor of the first.
    """
    made, i = [], 0
    while i < len(rows):
        low = at[rows[i]]
        last = max(np.searchsorted(at, low + SLICE, "right") - 1, rows[i] + 1)
        j = int(np.searchsorted(rows, last))
        least, far = _digits(raw[low : at[rows[j - 1] + 1]])
        off = _ranges(begin[i:j] - low, count[i:j])
        row, anchor = np.repeat(rows[i:j], count[i:j]), off + far[off]
        own = raw[low : at[rows[j - 1] + 1]]
        alike = np.concatenate([[0], np.cumsum(own[1:] == own[:-1], dtype=np.int32)])
        one = alike[off + DEPTH - 1] - alike[off] == DEPTH - 1
        group = np.where(one, -1 - off // CONSTANT, anchor)
        new = _heads(row) | _heads(group)
        new[1:] |= np.diff(off) != 1
        first = np.flatnonzero(new)
        made.append((off[first] + low, np.diff(np.append(first, len(off))), row[first], anchor[first] + low, least[off[first]]))
        i = j
    return [np.concatenate(x) for x in zip(*made)]


def _rest(frag, window, n):
    """What is left of fragments that lost windows: fragment, first window, count; untouched fragments as they were."""
    hit = np.unique(frag)
    gone = np.zeros(int(n[hit].sum()), bool)
    base = np.cumsum(n[hit]) - n[hit]
    gone[base[np.searchsorted(hit, frag)] + window] = True
    own, place = np.repeat(hit, n[hit])[~gone], _ranges(np.zeros(len(hit), np.int64), n[hit])[~gone]
    new = _heads(own)
    new[1:] |= np.diff(place) != 1
    first = np.flatnonzero(new)
    whole = np.setdiff1d(np.arange(len(n)), hit)
    sizes = np.diff(np.append(first, len(own)))
    return np.concatenate([whole, own[first]]), np.concatenate([np.zeros(len(whole), np.int64), place[first]]), np.concatenate([n[whole], sizes])


def _cut(buckets: int, with_text: bool):
    """Batches of (id, mark, text) or (id, mark, packed text, starts, counts) -> spans that a batch settles by itself, and for each
    bucket blocks of fragments: of all windows, or of those that the lists name; with or without their text."""

    def rows_of(raw, at, ids, marks, lists):
        if lists is None:
            rows = np.flatnonzero(np.diff(at) >= DEPTH)
            begin, count = at[:-1][rows], np.diff(at)[rows] - DEPTH + 1
        else:
            rows, begin, count = lists
            order = np.lexsort((begin, rows))
            rows, count = rows[order], count[order]
            begin = begin[order] + at[rows]
        if not len(rows):
            return
        f_at, n, f_row, f_anchor, f_digit = _fragments(raw, at, rows, begin, count)
        frag, window = settle(raw, f_at, n, ids[f_row], f_digit)
        if len(frag):
            key = f_row[frag]
            pick, start, end = _spans(key, f_at[frag] + window - at[key])
            key = key[pick]
            yield _found((mixed(ids[key]) % np.uint64(buckets)).astype(np.int32), ids[key], marks[key], start, end)
            own, place, n = _rest(frag, window, n)
            f_at, f_row, f_anchor, f_digit = f_at[own] + place, f_row[own], f_anchor[own], f_digit[own]
            f_anchor = np.maximum(f_anchor, f_at)
            if not len(own):
                return
        bucket = (f_digit % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((f_at, bucket))
        bucket, n, f_at, f_row, f_anchor, f_digit = (x[order] for x in (bucket, n, f_at, f_row, f_anchor, f_digit))
        if with_text:
            digests = [(f_digit >> np.uint64(32)).astype("<u4")]
        else:
            digests = [x.view(np.uint8).reshape(-1, 4)[:, :3] for x in _sides(raw, f_anchor)]
        edges = np.flatnonzero(_heads(bucket))
        press = zstandard.ZstdCompressor(level=5 if with_text else 1)
        names, blocks = [], []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
            used, back = np.unique(f_row[a:b], return_inverse=True)
            text = raw[_ranges(f_at[a:b], n[a:b] + DEPTH - 1)] if with_text else raw[:0]
            parts = [
                np.array([b - a, len(used), len(text)], "<i8"), ids[used].astype("<i8"), marks[used].astype("<i8"), (f_at[a:b] - at[f_row[a:b]]).astype("<u4"),
                np.diff(back, prepend=0).astype("<i2") if len(used) < 30_000 else back.astype("<u4"), n[a:b].astype(np.uint8), (f_anchor[a:b] - f_at[a:b]).astype(np.uint8),
                *(np.ascontiguousarray(x[a:b]) for x in digests), text,
            ]
            names.append(int(bucket[a]))
            blocks.append(press.compress(b"".join(x.tobytes() for x in parts)))
            if len(names) == 256:
                yield _blocks(names, blocks)
                names, blocks = [], []
        if names:
            yield _blocks(names, blocks)

    def joined(held):
        at, base, many = [np.zeros(1, np.int64)], 0, []
        rows = 0
        for _, x, _, _, lists in held:
            at.append(x[1:] + base)
            base += int(x[-1])
            if lists is not None:
                many.append((lists[0] + rows, lists[1], lists[2]))
            rows += len(x) - 1
        # the pad keeps eight-byte reads inside the array
        raw = np.concatenate([*(x[0] for x in held), np.zeros(64, np.uint8)])
        lists = tuple(np.concatenate([m[k] for m in many]) for k in range(3)) if many else None
        with np.errstate(over="ignore"):
            yield from rows_of(raw, np.concatenate(at), np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), lists)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            raw, at = flat(batch.column(2) if batch.num_columns == 3 else unpacked(batch.column(2)))
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            i, n = 0, len(at) - 1
            while i < n:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES - size, "right")) - 1)
                j = min(j, n)
                lists = None
                if batch.num_columns > 3:
                    starts, counts = batch.column(3).slice(i, j - i), batch.column(4).slice(i, j - i)
                    lengths = pc.list_value_length(starts).to_numpy(zero_copy_only=False)
                    lists = np.repeat(np.arange(j - i), lengths), starts.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
                held.append((raw[at[i] : at[j]].copy(), at[i : j + 1] - at[i], ids[i:j], marks[i:j], lists))
                size += int(at[j] - at[i])
                i = j
                if size >= BATCH_BYTES * 0.9:
                    yield from joined(held)
                    held, size = [], 0
                    tidy()
        if held:
            yield from joined(held)

    return run


def _opened(table: pa.Table, with_text: bool):
    """Fragments of all blocks of a bucket: id, mark, start, n, anchor, then digit and text, or two digests."""
    open_, found = zstandard.ZstdDecompressor(), []
    for block in table.column("block").drop_null().to_pylist():
        data, spot = open_.decompress(block), 0

        def next_(kind, n):
            nonlocal spot
            got = np.frombuffer(data, kind, n, spot)
            spot += got.nbytes
            return got

        f, d, t = next_("<i8", 3).tolist()
        own_ids, own_marks, start = next_("<i8", d), next_("<i8", d), next_("<u4", f)
        back = np.cumsum(next_("<i2", f), dtype=np.int64) if d < 30_000 else next_("<u4", f)
        n, anchor = next_(np.uint8, f), next_(np.uint8, f)
        one = [own_ids[back], own_marks[back], start.astype(np.int64), n.astype(np.int64), anchor.astype(np.int64)]
        if with_text:
            one += [next_("<u4", f), next_(np.uint8, t)]
        else:
            for _ in range(2):
                x = next_(np.uint8, 3 * f).reshape(-1, 3).astype(np.uint32)
                one.append(x[:, 0] | (x[:, 1] << 8) | (x[:, 2] << 16))
        found.append(one)
    return [np.concatenate(x) for x in zip(*found)] if found else None


_OUT = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32())])


def _told(table: pa.Table, *more) -> pa.Table:
    """Spans that batches settled (n is 0), and more rows."""
    done = table.filter(pc.is_null(table.column("block")))
    done = pa.table({"id": done.column("id"), "mark": done.column("mark"), "start": done.column("start"), "end": done.column("end"), "n": pa.array(np.zeros(len(done), np.int32))}).cast(_OUT)
    if not more:
        return done
    return pa.concat_tables([done, pa.table([pa.array(x, f.type) for x, f in zip(more, _OUT)], schema=_OUT)])


def _shared(table: pa.Table) -> pa.Table:
    """One bucket of fragments without text -> the windows that may occur in several documents.

    A window from SIDE bytes or more before the anchor on holds the bytes of the first digest, one from SIDE bytes or less
    before it on those of the second; where no other document has the digest the windows are out.
    """
    got = _opened(table, False)
    if got is None:
        return _told(table)
    ids, marks, start, n, anchor, *digests = got
    split = anchor - SIDE  # this window, counted from the first one, holds both
    n_left = np.clip(split + 1, 0, n)
    from_right = np.clip(split, 0, n)
    keep = []
    for digest, some in zip(digests, (n_left > 0, from_right < n)):
        rows = np.flatnonzero(some)
        rows = rows[np.argsort(digest[rows])]
        hit = np.zeros(len(ids), bool)
        hit[rows[_mixed_docs(digest[rows], ids[rows])]] = True
        keep.append(hit)
    left, right = keep
    some = np.flatnonzero(left | right)
    begin = np.where(left, 0, from_right)[some]
    count = np.where(right, n, n_left)[some] - begin
    zero = np.zeros(len(some), np.int32)
    return _told(table, ids[some], marks[some], (start[some] + begin).astype(np.int32), zero, count.astype(np.int32))


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """One bucket of fragments with text -> spans."""
    got = _opened(table, True)
    if got is None:
        return _told(table)
    ids, marks, start, n, _, digit, text = got
    raw = np.concatenate([text, np.zeros(64, np.uint8)])
    ends = np.cumsum(n + DEPTH - 1)
    with np.errstate(over="ignore"):
        frag, window = settle(raw, ends - (n + DEPTH - 1), n, ids, digit)
    if not len(frag):
        return _told(table)
    order = np.lexsort((marks[frag], ids[frag]))
    frag, window = frag[order], window[order]
    key = np.cumsum(_heads(ids[frag]) | _heads(marks[frag]))
    pick, begin, end = _spans(key, start[frag] + window)
    pick = frag[pick]
    return _told(table, ids[pick], marks[pick], begin.astype(np.int32), end.astype(np.int32), np.zeros(len(pick), np.int32))


def _without(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    raw, at = flat(unpacked(text))
    out = []
    for k in range(len(text)):
        own = raw[at[k] : at[k + 1]]
        gone, runs = _covered(len(own), starts[k].as_py() or (), ends[k].as_py() or ())
        out.append({"n_bytes": len(own), "n_removed": int(gone.sum()), "n_spans": runs, "kept_sha256": hashlib.sha256(own[~gone].tobytes()).hexdigest()})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def _covered(n: int, starts, ends) -> tuple[np.ndarray, int]:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.array(starts, np.int64), 1)
    np.add.at(step, np.array(ends, np.int64), -1)
    gone = np.cumsum(step)[:n] > 0
    return gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def repeated_spans(rows: DataFrame) -> DataFrame:
    """rows: id, mark, text. -> id, mark, starts, ends: of each document with repeated bytes its spans, which may overlap; mark
    is a hash of the text, which tells rows that share an id apart."""
    spark = rows.sparkSession
    bounded_batches(spark)
    buckets = min(max(24, stored_bytes(rows, "text") // BUCKET_BYTES), (1 << 31) - 1)
    # whole copies go first: of equal texts the one with the smallest id has all windows of the others
    copies = exact_duplicates(rows, "id", "text").where("not kept and id > keep_id").select("id", F.lower(F.hex("digest")).alias("sha")).distinct()
    sized = rows.select("id", "mark", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("sha"))
    copies = saved(sized.join(copies, ["id", "sha"], "left_semi").select("id", "mark", "n").distinct())
    copied = IdFilter(copies.select("id").distinct())
    release(spark)
    maybe = copied.has(F.col("id"))
    single = rows.where(~maybe).unionByName(rows.where(maybe).join(copies, ["id", "mark"], "left_anti")).select("id", "mark", "text")
    out = "id bigint, mark bigint, start int, end int, n int"
    spans = [F.collect_list(F.when(F.col("n") == 0, F.col(c))).alias(f"{c}s") for c in ("start", "end")]
    open_ = [F.collect_list(F.when(F.col("n") > 0, F.col(c))).alias(name) for c, name in (("start", "firsts"), ("n", "counts"))]
    first = saved(single.mapInArrow(_cut(buckets, False), ROW).groupBy("bucket").applyInArrow(_shared, out).groupBy("id", "mark").agg(*spans, *open_))
    release(spark)
    left = first.where(F.size("firsts") > 0).select("id", "mark", "firsts", "counts")
    wanted = IdFilter(left.select("id").distinct())
    met = packed(rows.where(wanted.has(F.col("id"))), "text", "id", "mark").join(left, ["id", "mark"]).select("id", "mark", "packed", "firsts", "counts")
    second = saved(met.mapInArrow(_cut(buckets, True), ROW).groupBy("bucket").applyInArrow(_sorted_bucket, out).groupBy("id", "mark").agg(*spans))
    release(spark)
    whole = copies.select("id", "mark", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    both = first.where(F.size("starts") > 0).select("id", "mark", "starts", "ends").unionByName(second).unionByName(whole)
    return both.groupBy("id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a DEPTH-byte string that covers it also starts in a document with a smaller id. Null text is empty; texts
    under DEPTH bytes lose nothing. Rows that share an id don't take from each other; rows with a null id are left as they
    are. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = saved(repeated_spans(rows.where((F.octet_length("text") >= DEPTH) & F.col("id").isNotNull())))
    touched = IdFilter(spans.select("id").distinct())
    maybe = F.coalesce(touched.has(F.col("id")), F.lit(False))
    whole = rows.where(~maybe).select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    met = packed(rows.where(maybe), "text", "id", "mark").join(spans, ["id", "mark"], "left")
    cut = met.select("id", F.arrow_udf(_without, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")("packed", "starts", "ends").alias("r")).select("id", "r.*")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def op8(spark, sf_dir: str) -> DataFrame:
    return dedup_report(documents(spark, sf_dir, "doc_id", "text"))


SQL8 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM h WHERE length(h) >= 100),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM p),
o AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN o USING (s) WHERE doc_id > owner),
e AS (SELECT doc_id, i, CAST(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS INT) AS apart FROM hit),
g AS (SELECT doc_id, i, sum(coalesce(apart, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, -1, 0 FROM h)),
t AS (SELECT k.doc_id, string_agg(substring(h, 2 * k.a + 1, 2 * (coalesce(k.b, length(h) // 2) - k.a)), '' ORDER BY k.a) AS kept FROM k JOIN h USING (doc_id) GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
