"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles. K minimum hashes, each cut to BITS bits, are its signature; two
signatures differ in so many of the K positions. The positions are split in CHUNKS chunks. By pigeonhole a pair that
differs in at most MOST = CHUNKS * (ERRORS + 1) - 1 positions has a chunk with at most ERRORS differences, so each document
is indexed, for every chunk, under the chunk with every choice of ERRORS positions left out: every pair within that distance
meets under some key. A pair of similarity 0.85 differs in more places once in 60 million (0.8: once in 600,000).

Equal sets are one class, named by its smallest id, before anything is joined. No step takes all pairs of a group that is
close: under a key every signature is first compared with that of the key's smallest id, and only those that are too far
from it (mostly none) are compared with the others, in blocks. The pairs within the distance make clusters. In a cluster
every whole shingle set is first compared with that of its middle, the member nearest to the majority of the signatures'
lowest bits; those that are not linked to it are compared with all others, in blocks of bounded size. Both are exact for the
components: members that are linked to one and the same need not be compared with each other. Components of the true links
are the result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import IdFilter, bounded_batches, documents, flat, mixed, saved, slices, tidy

CHUNKS, WIDTH, ERRORS, BITS = 10, 5, 1, 16
K = CHUNKS * WIDTH
MOST = CHUNKS * (ERRORS + 1) - 1
#: Signatures of a key that are compared with all others in one task, and text of a cluster that meets in one block; a task
#: sees two blocks at most.
BLOCK, BLOCK_BYTES = 2048, 2 << 20
SLICE = 1 << 18
#: Parts that the neighbours of one node are dealt to.
SALTS = 32

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, K, dtype=np.uint64)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.multiply.accumulate(np.full(n, x, np.uint64))]) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))


@functools.cache
def _common_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(SLICE + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 powers up and down; those of a slice are kept, longer ones go with their text."""
    return _common_powers() if n <= SLICE + 1 else _made_powers(n)


def _is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _of_long(raw: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one row, a piece at a time; a piece begins with the last words of the one before."""
    found, a, n, step = [], 0, len(raw), SLICE // 2
    while a < n:
        b = a
        while True:
            b = min(b + step, n)
            space = _is_space(raw[a:b])
            starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            if b == n:
                break
            # the last word may go on after b
            if len(starts) > 2 * words:
                b = a + int(starts[-1])
                starts = starts[:-1]
                break
        if found and len(starts) < words:
            break
        found.append(shingles(raw[a:b], np.array([0, b - a]), words)[0])
        if b == n:
            break
        a += int(starts[len(starts) - words + 1]) if words > 1 else b - a
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows behind one another, and n+1 offsets, worked off in slices."""
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for i, j in slices(at, SLICE):
            if at[j] - at[i] > SLICE:
                hashes = _of_long(raw[at[i] : at[j]], words)
                size = np.array([len(hashes)])
            else:
                hashes, cut = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], words)
                size = np.diff(cut)
            found.append(hashes)
            sizes.append(size)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def shingles(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of some rows behind one another, and n+1 offsets.

    A-Z are lower-cased; words are runs without space, tab, line feed, vertical tab, form feed, carriage return. A row with
    fewer words than a shingle has its whole sequence as one; a row without words has none.
    """
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    up, down = _powers(len(low) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * up[: len(low)], dtype=np.uint64)])
    word = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    row = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(row, np.arange(n + 1))
    have = np.diff(first)
    made = np.zeros(len(word), np.uint64)
    for k in range(words):
        turned = np.concatenate([word[k:], np.zeros(min(k, len(word)), np.uint64)])
        made = made * np.uint64(0x100000001B3) + turned
    full = np.ones(len(word), bool)
    for k in range(1, words):
        full &= np.concatenate([row[k:] == row[: len(row) - k], np.zeros(min(k, len(row)), bool)]) if k < len(row) else False
    rows, hashes = row[full], mixed(made[full])
    few = np.flatnonzero((have > 0) & (have < words))
    if len(few):
        short = []
        for r in few.tolist():
            h = np.uint64(have[r])
            for x in word[first[r] : first[r + 1]]:
                h = mixed(np.array([h * np.uint64(0x100000001B3) + x]))[0]
            short.append(h)
        rows, hashes = np.concatenate([rows, few]), np.concatenate([hashes, np.array(short, np.uint64)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    return hashes, np.searchsorted(rows, np.arange(n + 1))


def _signed(words: int):
    """Batches of (id, text, mark) -> id, mark, bytes of text, size and digest of the set, signature."""

    def run(batches):
        for batch in batches:
            raw, at = flat(batch.column(1))
            n = len(at) - 1
            sets, sizes, signs = [], np.zeros(n, np.int64), np.zeros((n, K), np.int32)
            for i, j in slices(at, SLICE):
                hashes, cut = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], words)
                size = sizes[i:j] = np.diff(cut)
                sets += [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cut[:-1], cut[1:])]
                some = np.flatnonzero(size)
                if len(some):
                    with np.errstate(over="ignore"):
                        for k in range(K):
                            least = np.minimum.reduceat(hashes * _A[k] + _B[k], cut[:-1][some])
                            signs[i + some, k] = (mixed(least) >> np.uint64(64 - BITS)).astype(np.int32)
            signature = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * K), pa.array(signs.reshape(-1)))
            out = [batch.column(0), batch.column(2), pa.array(np.diff(at)), pa.array(sizes), pa.array(sets, pa.binary()), signature]
            del raw, signs
            tidy()
            yield pa.RecordBatch.from_arrays(out, names=["id", "mark", "bytes", "n", "set", "sign"])

    return run


def _distance(a: Column, b: Column) -> Column:
    """In how many places two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _keys(sign):
    """One hash for each chunk and choice of positions left out."""
    kept = itertools.product(range(CHUNKS), itertools.combinations(range(WIDTH), WIDTH - ERRORS))
    return F.array(*[F.xxhash64(F.lit(i), *[sign[c * WIDTH + p] for p in spots]) for i, (c, spots) in enumerate(kept)])


def components(edges: DataFrame) -> DataFrame:
    """node, least: the smallest node reachable over edges (a, b). Large-star and small-star steps, hubs pre-aggregated.

    Nodes without edges do not appear. Each step is one minimum per node and one join, so no group is gathered.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        # a hub's neighbours are dealt to several parts, and its least one goes to each of those
        least = both.groupBy("a", "salt").agg(F.min("b").alias("m")).groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"), F.collect_set("salt").alias("salts"))
        least = least.select("a", "m", F.explode("salts").alias("salt"))
        large = both.join(least, ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        edges = saved(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())
        before = now


def _out(links, names=("a", "b"), kinds=(pa.int64(), pa.int64())):
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k, kind in enumerate(kinds)], names=list(names))


def _grouped(batches, keys: int):
    """Runs of rows with equal first `keys` columns, as lists of Python rows, a batch end being no end of a run."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != key:
                if rows:
                    yield rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield rows


def _near_others(batches):
    """Batches of (key, block, side, id, sign), sorted -> links of signatures within the distance. Those of side 0 are compared
    with each other and with all of side 1; of the links only those leave that join groups which were apart."""

    def close(held, others):
        ids = [x[1] for x in held]
        signs = np.frombuffer(b"".join(x[2] for x in held), "<i2").reshape(len(held), K)
        group, links = np.arange(len(held)), []
        for x in range(len(held) - 1):
            apart = np.flatnonzero(group[x + 1 :] != group[x]) + x + 1
            for y in apart[(signs[apart] != signs[x]).sum(1) <= MOST].tolist():
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    links.append((ids[y], ids[x]))
        for _, other, sign in others:
            met = np.flatnonzero((signs != np.frombuffer(sign, "<i2")).sum(1) <= MOST)
            if len(met):
                found, first = np.unique(group[met], return_index=True)
                links += [(other, ids[y]) for y in met[first].tolist()]
                group[np.isin(group, found)] = found[0]
        return links

    found = []
    for rows in _grouped(batches, 2):
        held = [x for x in rows if x[0] == 0]
        if held and len(rows) > 1:
            found += close(held, [x for x in rows if x[0] == 1])
        if len(found) > 5000:
            yield _out(found)
            found = []
    yield _out(found)


def _close_pairs(classes: DataFrame, block: int) -> DataFrame:
    """classes: id, sign. -> links (a, b) whose components are those of all pairs within MOST differences that share a key."""
    keys = classes.select("id", F.explode(_keys(F.col("sign"))).alias("key"))
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head")
    met = saved(keys.join(heads, "key").where("id <> head"))
    one, other = classes.select("id", "sign"), classes.select(F.col("id").alias("head"), F.col("sign").alias("other"))
    pairs = met.select("id", "head").distinct().join(one, "id").join(other, "head")
    told = saved(pairs.select("id", "head", (_distance(F.col("sign"), F.col("other")) <= MOST).alias("near")))
    # what is too far from the head of its key meets the rest of the key
    each = met.join(told, ["id", "head"]).select("key", "id", "near")
    left = each.groupBy("key").agg(F.count_if(~F.col("near")).alias("far"), F.count("*").alias("c")).where("far > 0 and c > 1")
    open_ = each.join(left, "key").withColumn("blocks", F.ceil(F.col("far") / F.lit(block)).cast("int"))
    own = F.when(F.col("near"), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = open_.withColumn("own", own).withColumn("block", F.explode(F.sequence("own", F.col("blocks") - 1)))
    side = F.when(~F.col("near") & (F.col("own") == F.col("block")), 0).otherwise(1)
    packed = one.select("id", F.arrow_udf(_packed_sign, "binary")("sign").alias("sign"))
    dealt = dealt.select("key", "block", side.alias("side"), "id").join(packed, "id").select("key", "block", "side", "id", "sign")
    met_others = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "side").mapInArrow(_near_others, "a bigint, b bigint")
    return told.where("near").select(F.col("id").alias("a"), F.col("head").alias("b")).unionByName(met_others).distinct()


def _packed_sign(sign: pa.Array) -> pa.Array:
    """Signatures as bytes: 16 bits a place."""
    data = sign.flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes()
    return pa.array([data[i : i + 2 * K] for i in range(0, len(data), 2 * K)], pa.binary())


def _to_middle(words: int, percent: int):
    """Batches of (cluster, part, later, id, text), sorted -> cluster, id and whether the set is linked to that of the first
    row of its part, the middle of the cluster."""

    def run(batches):
        key, middle = None, None
        for batch in batches:
            raw, at = flat(batch.column(4))
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            later, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = []
            for i, j in slices(at, SLICE):
                hashes, cut = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], words)
                for k in range(i, j):
                    own = hashes[cut[k - i] : cut[k - i + 1]]
                    if not later[k]:
                        key, middle = names[k], own.copy()
                        continue
                    assert key == names[k]
                    spot = np.minimum(np.searchsorted(middle, own), len(middle) - 1)
                    common = int((middle[spot] == own).sum())
                    found.append((names[k][0], ids[k], 100 * common >= percent * (len(own) + len(middle) - common)))
            tidy()
            yield _out(found, ("cluster", "id", "linked"), (pa.int64(), pa.int64(), pa.bool_()))

    return run


def _forest(ids: np.ndarray, hashes: np.ndarray, cut: np.ndarray, half: int, one: bool, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs with 100 * common >= percent * union. half: rows of the first block; with two
    blocks only pairs across count, each block has a task of its own. one: the first block's rows are linked already."""
    n = len(ids)
    size = np.diff(cut)
    # shingles of one row only cannot be common
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(hashes, kind="stable")
    sorted_hashes, sorted_owner = hashes[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    code = np.cumsum(new) - 1
    shared = np.bincount(code)[code] > 1
    code, sorted_owner = code[shared], sorted_owner[shared]
    by_row = np.lexsort((code, sorted_owner))
    code, rows = code[by_row], sorted_owner[by_row]
    start = np.searchsorted(rows, np.arange(n + 1))
    could = np.diff(start)
    by_code = np.lexsort((rows, code))
    post, post_rows = code[by_code], rows[by_code]
    post_at = np.searchsorted(post, np.arange((post[-1] + 2) if len(post) else 1))
    group, links, across = np.arange(n), [], half < n
    if one:
        group[:half] = 0
    # the rows with most shared shingles first: they stand in the middle of their group, so few rows link it whole
    for x in np.argsort(size - could, kind="stable").tolist():
        most = np.minimum(could[x], could)
        open_ = (group != group[x]) & (most > 0) & (100 * most >= percent * (size[x] + size - most))
        if across:
            open_ &= (np.arange(n) < half) != (x < half)
        if not open_.any():
            continue
        spans = [post_rows[post_at[c] : post_at[c + 1]] for c in code[start[x] : start[x + 1]].tolist()]
        common = np.bincount(np.concatenate(spans), minlength=n)
        for y in np.flatnonzero(open_ & (100 * common >= percent * (size[x] + size - common))).tolist():
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                links.append((int(ids[x]), int(ids[y])))
    return links


def _verified(words: int, percent: int):
    """Batches of (cluster, one, two, side, near, id, text), sorted -> links across the two blocks, or inside one."""

    def close(rows):
        rows = sorted(set(rows), key=lambda r: (r[0], r[2]))
        raw, at = flat(pa.array([r[3] for r in rows], pa.large_string()))
        hashes, cut = shingle_sets(raw, at, words)
        half = sum(1 for r in rows if r[0] == 0)
        return _forest(np.array([r[2] for r in rows], np.int64), hashes, cut, half, rows[0][1], percent)

    def run(batches):
        for rows in _grouped(batches, 3):
            links = close(rows) if len(rows) > 1 else []
            if links:
                yield _out(links)
            tidy()

    return run


def _links(rows: DataFrame, classes: DataFrame, words: int, percent: int, block_bytes: int, block: int) -> DataFrame:
    """rows: id, mark, text; classes: id, mark, bytes, sign. -> links (a, b) with the components of all true links."""
    clusters = components(_close_pairs(classes, block)).toDF("id", "cluster")
    members = saved(clusters.join(classes, "id").select("cluster", "id", "mark", "bytes", F.transform("sign", lambda x: x.bitwiseAND(F.lit(1))).alias("bits")))
    usual = members.groupBy("cluster").agg(F.array(*[F.round(F.avg(F.col("bits")[k])).cast("int") for k in range(K)]).alias("usual"), F.ceil(F.sum("bytes") / F.lit(block_bytes)).cast("int").alias("parts"))
    middles = members.join(usual, "cluster").groupBy("cluster").agg(F.min(F.struct(_distance(F.col("bits"), F.col("usual")).alias("d"), "id"))["id"].alias("middle"), F.max("parts").alias("parts"))
    dealt = members.join(middles, "cluster").select("cluster", "id", "mark", "bytes", "middle", "parts")
    wanted = IdFilter(clusters.select("id"))
    known = rows.where(wanted.has(F.col("id")))

    def with_text(some: DataFrame) -> DataFrame:
        return known.join(some, ["id", "mark"]).select(*some.columns, "text").distinct()

    # every member against the middle of its cluster
    places = F.when(F.col("id") == F.col("middle"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    one = with_text(dealt.where("parts > 0").select("id", "mark", "cluster", "middle", "parts")).withColumn("part", F.explode(places))
    one = one.select("cluster", "part", (F.col("id") != F.col("middle")).alias("later"), "id", "text")
    one = one.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "later")
    met = saved(one.mapInArrow(_to_middle(words, percent), "cluster bigint, id bigint, linked boolean"))
    # what isn't linked to the middle against all others
    sized = met.join(dealt.select("id", "mark", "bytes"), "id")
    size = lambda c: F.ceil(F.sum(F.when(c, F.col("bytes")).otherwise(0)) / F.lit(block_bytes)).cast("int")
    left = sized.groupBy("cluster").agg(size(F.col("linked")).alias("near"), size(~F.col("linked")).alias("far"), F.count("*").alias("c")).where("far > 0 and c > 1")
    open_ = sized.join(left, "cluster").withColumn("own", F.when(F.col("linked"), F.pmod(F.xxhash64("id"), F.col("near"))).otherwise(F.col("near") + F.pmod(F.xxhash64("id"), F.col("far"))).cast("int"))
    rest = with_text(open_.select("id", "mark", "cluster", "linked", "near", "far", "own"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.when(F.col("linked"), F.col("near")).otherwise(0), F.col("near") + F.col("far") - 1)))
    rest = rest.select("cluster", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"), "linked", "id", "text")
    rest = rest.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "side").mapInArrow(_verified(words, percent), "a bigint, b bigint")
    first = met.where("linked").join(middles, "cluster").select(F.col("id").alias("a"), F.col("middle").alias("b"))
    return first.unionByName(rest)


def _components_of(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block_bytes: int = BLOCK_BYTES, block: int = BLOCK) -> DataFrame:
    """id, mark (hash of the text), n, component_id of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    signed = saved(rows.select("id", "text", "mark").mapInArrow(_signed(words), "id bigint, mark bigint, bytes bigint, n bigint, set binary, sign array<int>"))
    best = F.min(F.struct("id", "mark", "bytes", "sign")).alias("x")
    classes = saved(signed.where("n > 0 and id is not null").groupBy("set").agg(best).select("set", "x.*"))
    found = components(_links(rows, classes, words, percent, block_bytes, block)).toDF("id", "component_id")
    named = classes.select("set", "id").join(found, "id", "left").select("set", F.coalesce("component_id", "id").alias("component_id"))
    out = signed.select("id", "mark", "n", "set").join(named, "set", "left")
    return out.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * common >= percent * union of their distinct shingles of `words` words. Null, empty
    and wordless texts have no shingles and are components of their own. Rows that repeat an id count as one document each
    and share the component of their own text; a null id gets a null component and is kept. Other columns are ignored.
    """
    out = _components_of(docs, id_col, text_col, words, percent, block_bytes, block)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns as they were."""
    out = _components_of(docs, id_col, text_col, words, percent).where("id <> component_id")
    out = saved(out.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct())
    gone = IdFilter(out.select("__id").distinct())
    maybe = F.coalesce(gone.has(F.col(id_col).cast("bigint")), F.lit(False))
    same = (docs[id_col] == F.col("__id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__mark"))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(out, same, "left_anti"))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=3, percent=85)


SQL7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, len(w) < 3 AS short, array_to_string(w[i:i + 2], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, both_ways.b FROM r JOIN both_ways ON r.reached = both_ways.a),
m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m ON m.id = doc_id LEFT JOIN n USING (doc_id)
"""
