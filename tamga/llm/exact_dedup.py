"""Exact dedup with a log-structured merge index over text digests.

Each task fills a memtable (digest -> smallest key, member ids), verifies every hit byte by byte against the text it
holds, and flushes sorted runs. Compaction merges the runs by digest and keeps the smallest key. A digest that turns up
in several runs is a hit across runs: the texts of the runs' representatives are fetched through a bounded filter and
compared byte by byte before their runs merge. The key of a document is its id, or its negated id when the largest stays.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import IdFilter, bounded_batches, documents, flat, saved

#: A memtable is flushed at so many bytes of text.
MEMTABLE_BYTES = 24 << 20
RUN = "digest binary, rep bigint, mark bigint, ids array<bigint>, n bigint"


def _runs(keep: str, digest_bytes: int, memtable_bytes: int):
    schema = pa.schema([("digest", pa.binary()), ("rep", pa.int64()), ("mark", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])

    def flushed(table):
        found = []
        best = min if keep == "smallest" else max
        for digest, entries in table.items():
            for _, mark, ids in entries:
                some = [x for x in ids if x is not None]
                found.append((digest, best(some) if some else None, mark, ids, len(ids)))
        found.sort(key=lambda x: x[0])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    def run(batches):
        table, held = {}, 0
        for batch in batches:
            raw, at = flat(batch.column(1))
            view, at = memoryview(raw), at.tolist()
            for k, (doc, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = view[at[k] : at[k + 1]]
                digest = hashlib.sha256(text).digest()[:digest_bytes]
                entries = table.get(digest)
                if entries is None:
                    table[digest] = [(text, mark, [doc])]
                else:
                    for known, _, ids in entries:
                        if known == text:
                            ids.append(doc)
                            break
                    else:
                        entries.append((text, mark, [doc]))
                held += len(text) + 64
                if held >= memtable_bytes:
                    yield flushed(table)
                    table, held = {}, 0
        if table:
            yield flushed(table)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Null text counts as empty, so null and empty texts are one group. Repeated rows count each; rows that repeat the kept
    id are all kept. A null id never is the kept one unless all ids of its group are null. Other columns are ignored. An
    empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a mark finds a text again, also where ids are null or repeat
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("mark"))
    runs = saved(rows.mapInArrow(_runs(keep, digest_bytes, memtable_bytes), RUN))
    level = saved(runs.groupBy("digest").agg(best("rep").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("runs")))
    shared = level.where("runs > 1").select("digest")
    hits = saved(runs.join(shared, "digest", "left_semi").select("digest", "mark").distinct())
    wanted = IdFilter(hits.select("mark").distinct())
    texts = rows.where(wanted.has(F.col("mark"))).join(hits, "mark")
    checked = texts.where(F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes) == F.col("digest")).select("digest", "mark", "text")
    classes = checked.groupBy("digest", "text").agg(F.count("*").alias("reps"))
    clash = saved(classes.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest"))
    merged = runs.select("digest", "ids").join(level, "digest").select("digest", "keep_id", "group_size", "ids")
    if not clash.isEmpty():
        # one digest, several texts: these groups are told apart by their texts
        own = runs.join(clash, "digest", "left_semi").join(checked.distinct(), ["digest", "mark"])
        per = own.groupBy("digest", "text").agg(best("rep").alias("keep_id"), F.sum("n").alias("group_size"))
        apart = own.join(per, ["digest", "text"]).select("digest", "keep_id", "group_size", "ids")
        merged = merged.join(clash, "digest", "left_anti").unionByName(apart)
    out = merged.select(F.explode("ids").alias(id_col), "keep_id", "group_size", "digest")
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows that `exact_duplicates` drops; columns as they were."""
    out = exact_duplicates(docs, id_col, text_col, keep).where("not kept")
    out = saved(out.select(F.col(id_col).alias("__id"), F.lower(F.hex("digest")).alias("__sha")).distinct())
    gone = IdFilter(out.select("__id").distinct())
    maybe = F.coalesce(gone.has(F.col(id_col).cast("bigint")), F.lit(False))
    same = (docs[id_col] == F.col("__id")) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == F.col("__sha"))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(out, same, "left_anti"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir, "doc_id", "text"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL6 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text)
"""
