"""Balanced label propagation: documents into shards of even size, linked documents together.

A document begins in the shard of its hash. In each round a linked document wants to go where most of its group is; what wants to
move is summed by shard and target, quotas say which share of each flow fits the shards' capacity, and a hash decides who goes.
Documents without links are the ballast: they make room for groups, and are moved last until sizes are even. Members of an ordinary
group have one key for these decisions, so they go together; those of a group too large for that, of which there are few, have
one each, and such a group fills shard after shard.

Rounds are joins on the group; flows, quotas and histograms that the driver sees are bounded by the number of shards, of
large groups and of buckets. A round is written to the shared folder.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, saved

SHARDS = 8
#: A group with more than one part in so many of a shard's bytes or rows is a large one; there are 2 * LARGE * shards at most.
LARGE = 64
#: Rounds of propagation at most; what still wants to move then stays. Least share of linked bytes for another round.
ROUNDS, LEAST_MOVE = 16, 1e-4
#: By how much of its capacity a shard may be overfull with linked documents during rounds; sizes are made even after them.
SLACK = 1 / 16
#: Buckets of a histogram; rows that one task puts in order.
BUCKETS, NUMBERED = 1024, 4096
LONE, GROUPED, IN_LARGE = 0, 1, 2


def _unit(key: str, salt: int) -> Column:
    """A number in [0, 1) from a key's hash."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _bucket(key: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(BUCKETS)).cast("int")


def _nodes(rows: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """rows (id, size, crc, grp) with row, kind, key and first shard; the bytes of all."""
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("b")).where("n > 1")
    groups = saved(groups.withColumn("large", (F.col("b") * (LARGE * shards) > total) | (F.col("n") * (LARGE * shards) > n)))
    rows = rows.withColumn("own", F.xxhash64("id", "row"))
    large = groups.where("large").select("grp")
    # there are 2 * LARGE * shards large groups at most
    rows = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), "grp", "left")
    many = rows.where("large").withColumn("kind", F.lit(IN_LARGE))
    rest = rows.where("large is null").join(groups.where("not large").select("grp", F.lit(GROUPED).alias("kind")), "grp", "left")
    rest = rest.withColumn("kind", F.coalesce("kind", F.lit(LONE)))
    key = F.when(F.col("kind") == GROUPED, F.xxhash64("grp")).otherwise(F.col("own"))
    nodes = rest.unionByName(many).select("id", "size", "crc", "grp", "row", "kind", key.alias("key"), F.pmod("own", F.lit(shards)).cast("int").alias("shard"))
    return saved(nodes), total


def quotas(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest equal shares of each shard's inflow for which what comes is no more than its room and what goes."""
    share = np.ones(len(room))
    for _ in range(200):
        moved = wanted * share[None, :]
        comes, goes = moved.sum(0), moved.sum(1)
        fits = np.maximum(room + goes, 0)
        less = np.where(comes > fits, share * fits / np.maximum(comes, 1), share)
        if np.allclose(less, share, rtol=1e-9):
            break
        share = less
    return share


def _propagated(linked: DataFrame, shards: int, capacity: float) -> DataFrame:
    spark = linked.sparkSession
    for salt in range(ROUNDS):
        cells = saved(linked.groupBy("grp", "kind", "shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")))
        held = np.zeros(shards)
        for r in cells.groupBy("shard").agg(F.sum("b").alias("b")).collect():
            held[r["shard"]] = r["b"]
        room = capacity * (1 + SLACK) - held
        open_, free = room > 0, room > capacity * (SLACK + 1 / (16 * LARGE))
        # ordinary groups: the shard with most members among those that have room
        flags = F.array(*[F.lit(bool(x)) for x in open_])
        first = F.max(F.struct(F.get(flags, F.col("shard")).alias("open"), "n", F.xxhash64("grp", "shard").alias("tie"), "shard")).alias("best")
        targets = cells.where(F.col("kind") == GROUPED).groupBy("grp").agg(first).where("best.open").select("grp", F.col("best.shard").alias("target"))
        flows = cells.where(F.col("kind") == GROUPED).join(targets, "grp").where("shard <> target").groupBy("shard", "target").agg(F.sum("b").alias("b")).collect()
        wanted, wanted_large = np.zeros((2, shards, shards))
        for r in flows:
            wanted[r["shard"], r["target"]] += r["b"]
        # large groups: from where few members are to where most are and room is
        large: dict[str, list] = {}
        for r in cells.where(F.col("kind") == IN_LARGE).collect():
            large.setdefault(r["grp"], []).append((-r["n"], r["shard"], r["b"]))
        ways = []
        for grp, some in sorted(large.items(), key=lambda x: sum(n for n, _, _ in x[1])):
            some.sort()
            to = next((i for i, (_, s, _) in enumerate(some) if free[s]), None)
            for _, s, b in some[to + 1 :] if to is not None else ():
                ways.append((grp, s, some[to][1]))
                wanted_large[s, some[to][1]] += b
        # large groups keep to the capacity itself, or evening out would scatter what is over
        share, share_large = quotas(wanted, room), quotas(wanted + wanted_large, capacity - held)
        if (wanted * share + wanted_large * share_large).sum() <= LEAST_MOVE * held.sum():
            break

        def here(shares):
            goes = _unit("key", salt) < F.get(F.array(*[F.lit(float(x)) for x in shares]), F.col("target"))
            return F.when(F.col("target").isNotNull() & goes, F.col("target")).otherwise(F.col("shard")).alias("shard")

        columns = [c for c in linked.columns if c != "shard"]
        grouped = linked.where(F.col("kind") == GROUPED).join(targets, "grp", "left").select(*columns, here(share))
        paths = spark.createDataFrame(ways, "grp string, shard int, target int")
        many = linked.where(F.col("kind") == IN_LARGE).join(F.broadcast(paths), ["grp", "shard"], "left").select(*columns, here(share_large))
        linked = saved(grouped.unionByName(many))
    return linked


def evened(held: np.ndarray, buckets: list[tuple[int, int, int, int]]) -> dict[tuple[int, int, int], int]:
    """Moves (shard, kind, bucket) -> shard that make sizes even: from the largest shard to the smallest, about half the
    difference at a time, documents without links first. buckets: shard, kind, bucket, bytes. held changes in place."""
    lists: dict[tuple[int, int], list] = {}
    for shard, kind, bucket, b in buckets:
        lists.setdefault((shard, kind), []).append((b, (shard, kind, bucket)))
    for x in lists.values():
        x.sort()
    moves: dict[tuple[int, int, int], int] = {}
    while True:
        s, t = int(held.argmax()), int(held.argmin())
        apart = int(held[s] - held[t])
        for kind in (LONE, GROUPED, IN_LARGE):
            some = lists.get((s, kind), [])
            i = bisect.bisect_right(some, (apart // 2, (1 << 30,)))
            if i and some[i - 1][0] > 0:
                i -= 1
            elif i == len(some) or some[i][0] >= apart:
                continue
            b, name = some.pop(i)
            bisect.insort(lists.setdefault((t, kind), []), (b, name))
            held[s] -= b
            held[t] += b
            moves[name] = t
            break
        else:
            return {k: t for k, t in moves.items() if t != k[0]}


def _even(nodes: DataFrame, shards: int) -> DataFrame:
    """Sizes made even by buckets of keys, and by buckets within one bucket of each shard and kind."""
    spark = nodes.sparkSession
    columns = [c for c in nodes.columns if c != "shard"]
    inside: list[tuple[int, int, int]] | None = None
    for level in (0, 1):
        bucketed = nodes.withColumn("bucket", _bucket("key", 1000))
        if inside is not None:
            chosen = spark.createDataFrame(inside, "shard int, kind int, bucket int")
            finer = F.when(F.col("chosen"), BUCKETS + _bucket("key", 2000)).otherwise(F.col("bucket"))
            bucketed = bucketed.join(F.broadcast(chosen.withColumn("chosen", F.lit(True))), ["shard", "kind", "bucket"], "left").withColumn("bucket", finer).drop("chosen")
        # shards * 3 * 2 * BUCKETS rows at most
        buckets = [(r["shard"], r["kind"], r["bucket"], r["b"]) for r in bucketed.groupBy("shard", "kind", "bucket").agg(F.sum("size").alias("b")).collect()]
        held = np.zeros(shards, np.int64)
        for shard, _, _, b in buckets:
            held[shard] += b
        moves = evened(held, [x for x in buckets if level == 0 or x[2] >= BUCKETS])
        if moves:
            paths = spark.createDataFrame([(*k, t) for k, t in moves.items()], "shard int, kind int, bucket int, target int")
            nodes = saved(bucketed.join(F.broadcast(paths), ["shard", "kind", "bucket"], "left").select(*columns, F.coalesce("target", "shard").alias("shard")))
        least: dict[tuple[int, int], tuple] = {}
        for shard, kind, bucket, b in buckets:
            at = moves.get((shard, kind, bucket), shard)
            least[at, kind] = min(least.get((at, kind), (b, bucket)), (b, bucket))
        inside = [(shard, kind, bucket) for (shard, kind), (_, bucket) in least.items()]
        if not inside:
            break
    return nodes


def _slotted(nodes: DataFrame, rows: int) -> DataFrame:
    """nodes with `slot`: numbers of each shard's rows without a gap. Rows are put in order within buckets of a few thousand,
    buckets within blocks of buckets, and blocks within the shard."""
    buckets = max(1, rows // NUMBERED)
    nodes = nodes.withColumn("place", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(buckets)))
    counts = nodes.groupBy("shard", "place").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("place") / NUMBERED))
    blocks = counts.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("block_at"))
    starts = counts.select("shard", "place", "block", before(Window.partitionBy("shard", "block").orderBy("place")).alias("place_at")).join(blocks, ["shard", "block"])
    order = F.row_number().over(Window.partitionBy("shard", "place").orderBy("row")) - 1
    numbered = nodes.withColumn("order", order).join(starts, ["shard", "place"])
    return numbered.withColumn("slot", (F.col("order") + F.col("place_at") + F.col("block_at")).cast("bigint"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard (0 to shards - 1), slot (from 0 in each shard, without a gap), grp.

    Size is the text's UTF-8 bytes plus one. Documents with the same value of group_col, by default equal texts, are linked. Shards'
    sizes differ by less than the smallest document that could still move, or group where all documents are linked. Groups stay
    together except for a few that balance needs and those larger than a 64th of a shard, which fill as few shards as have room.
    Null text counts as empty; rows of a null group are not linked; null and repeated ids are rows like others. Other columns
    are ignored. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("there is one shard at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = F.sha2(text, 256) if group_col is None else F.coalesce(F.concat(F.lit("g"), F.col(group_col).cast("string")), F.concat(F.lit("u"), F.uuid()))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), group.alias("grp"))
    nodes, total = _nodes(rows, shards)
    linked = _propagated(nodes.where(F.col("kind") != LONE), shards, total / shards)
    nodes = saved(nodes.where(F.col("kind") == LONE).unionByName(linked))
    nodes = _even(nodes, shards)
    out = _slotted(nodes, nodes.count())
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot", "grp")


def op11(spark, sf_dir: str) -> DataFrame:
    found = balanced_shards(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
