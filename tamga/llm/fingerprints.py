"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A document is a weighted set: its tokens (pieces between white-space characters, the empty ones too) with their counts.
For sample k a token has r and c from Gamma(2, 1) and beta from [0, 1), all from hashes of token and k. With weight w it
stands at t = floor(ln w / r + beta) and scores ln a = ln c - r (t - beta + 1); the token with the least score is the
sample. The score itself names token and t, so it is the symbol that goes into the fingerprint: two documents agree in a
sample with a probability equal to the generalised Jaccard similarity of their weighted sets.

Documents are dealt by ranges of ids, each range with the one document that follows it, so neighbours and edited texts
need one shuffle of the texts. Samples are worked off in chunks to keep the generated code within what the JVM compiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, stored_bytes

SAMPLES, CHUNK = 40, 8
#: Text (as stored) of one range, quantiles of a step, and ranges that one task puts in order.
RANGE_BYTES, QUANTILES, LEVEL = 1 << 20, 256, 4096
#: Partitions over which ranges are dealt at most; a task puts those of its ranges in order by sorting.
PARTITIONS = 8192
#: Ranges up to which their first ids are broadcast, 24 bytes each.
BROADCAST_RANGES = 200_000


def _unit(word: Column, piece: int) -> Column:
    """21 of a hash's bits as a number in (0, 1)."""
    return (F.shiftrightunsigned(word, 21 * piece).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / float(1 << 21)


def _signed(terms: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """terms: keys, token (hash) and weights -> keys, one array of SAMPLES symbols (8 hex digits) per weight column."""
    logs = [F.ln(F.greatest(F.col(w), F.lit(1)).cast("double")).alias(f"ln_{w}") for w in weights]
    rows = terms.select(*keys, "token", *weights, *logs)
    rows = rows.withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in range(0, SAMPLES, CHUNK)])))
    # scores stand in a projection, where what they share is computed once; a weight of 0 is left out afterwards
    scores = []
    for i in range(CHUNK):
        one, two = (F.xxhash64("token", (F.col("chunk") + i) * 2 + k) for k in range(2))
        r = -F.ln(_unit(one, 0) * _unit(one, 1))
        ln_c = F.ln(-F.ln(_unit(two, 0) * _unit(two, 1)))
        beta = _unit(one, 2)
        for w in weights:
            t = F.floor(F.col(f"ln_{w}") / r + beta).cast("double")
            scores.append((ln_c - r * (t - beta + 1.0)).alias(f"{w}_{i}"))
    rows = rows.select(*keys, "chunk", *weights, *scores)
    least = [F.min(F.when(F.col(w) > 0, F.col(f"{w}_{i}"))).alias(f"{w}_{i}") for i in range(CHUNK) for w in weights]
    part = rows.groupBy(*keys, "chunk").agg(*least)
    symbol = lambda c: F.right(F.hex(F.xxhash64(c)), F.lit(8))
    part = part.select(*keys, "chunk", *[F.array(*[symbol(F.col(f"{w}_{i}")) for i in range(CHUNK)]).alias(w) for w in weights])
    whole = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", *weights))).alias("parts"))
    return whole.select(*keys, *[F.flatten(F.col(f"parts.{w}")).alias(w) for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal symbols of two fingerprints as arrays."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / SAMPLES


def fingerprints(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, symbols: the fingerprint of each row's text; key must tell rows apart. Null text counts as empty."""
    words = docs.select(key, F.explode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s", -1)).alias("word"))
    terms = words.groupBy(key, F.xxhash64("word").alias("token")).agg(F.count("*").alias("w"))
    return _signed(terms, [key], ["w"]).withColumnRenamed("w", "symbols")


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """docs with `range`, a number that grows with the id: quantiles, quantiles of each of those, and equal parts of these."""
    q = min(ranges, QUANTILES)
    inner = min(-(-ranges // q), QUANTILES)
    parts = -(-ranges // (q * inner))
    row = docs.agg(F.percentile_approx("id", [i / q for i in range(1, q)] or [0.5], 10_000).alias("m"), F.min("id").alias("least")).first()
    if row["least"] is None:
        return docs.withColumn("range", F.lit(0).cast("bigint"))
    cuts = sorted({row["least"], *(row["m"] if q > 1 else [])})
    found = F.aggregate(F.array(*[F.lit(x).cast("bigint") for x in cuts]), F.lit(-1), lambda n, x: n + (x <= F.col("id")).cast("int"))
    docs = docs.withColumn("__q", F.coalesce(F.greatest(found, F.lit(0)), F.lit(0)))
    if inner == 1:
        return docs.select("*", F.col("__q").cast("bigint").alias("range")).drop("__q")
    # at most QUANTILES rows of as many numbers
    marks = docs.groupBy("__q").agg(F.percentile_approx("id", [i / inner for i in range(1, inner)], 10_000).alias("__m"), F.min("id").alias("__least"), F.max("id").alias("__most"))
    docs = docs.join(F.broadcast(marks), "__q")
    place = F.aggregate(F.coalesce("__m", F.array().cast("array<bigint>")), F.lit(0), lambda n, x: n + F.coalesce((x <= F.col("id")).cast("int"), F.lit(0)))
    docs = docs.withColumn("__p", place)
    at = F.coalesce(F.get("__m", F.col("__p") - 1), "__least")
    to = F.coalesce(F.get("__m", F.col("__p")), F.col("__most") + 1)
    part = F.floor((F.col("id") - at).cast("double") * parts / F.greatest(to - at, F.lit(1)))
    part = F.coalesce(F.greatest(F.least(part, F.lit(parts - 1)), F.lit(0)), F.lit(0)) if parts > 1 else F.lit(0)
    number = (F.col("__q").cast("bigint") * inner + F.col("__p")) * parts + part
    return docs.select("*", number.cast("bigint").alias("range")).drop("__q", "__p", "__m", "__least", "__most")


def _next_range(heads: DataFrame) -> DataFrame:
    """heads: range and more, one row per range -> with `to`, the next range; after the last comes the first. LEVEL ranges are put
    in order in one task, and after that one row for each LEVEL of them."""
    rows = heads.withColumn("level", F.floor(F.col("range") / F.lit(LEVEL)))
    levels = rows.groupBy("level").agg(F.min("range").alias("first"))
    ends = Window.orderBy("level")
    levels = levels.select("level", F.coalesce(F.lead("first").over(ends), F.min("first").over(ends.rowsBetween(Window.unboundedPreceding, 0))).alias("next"))
    inside = rows.withColumn("to", F.lead("range").over(Window.partitionBy("level").orderBy("range")))
    return inside.join(levels, "level").withColumn("to", F.coalesce("to", "next")).drop("level", "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n/2) code points replaced by as many first ones (or all) of the next document in
    descending id; after the last comes the first. Rows that share an id follow by text; null ids come last. Null text is
    empty. A single document follows itself. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(48, stored_bytes(docs, text_col) // RANGE_BYTES)
    rows = _ranged(rows, ranges).withColumn("ghost", F.lit(0))
    # the first document of each range also closes the range above it; that of the topmost closes the lowest one
    heads = rows.groupBy("range").agg(F.max("id").alias("id"))
    heads = _next_range(heads)
    small = heads.count() <= BROADCAST_RANGES
    heads = heads.select("range", F.col("id").alias("head"), "to")
    met = rows.join(F.broadcast(heads) if small else heads, "range").where(F.col("id").eqNullSafe(F.col("head")))
    ghosts = met.groupBy("to").agg(F.max("id").alias("id"), F.min("text").alias("text")).select("id", "text", F.col("to").alias("range"), F.lit(1).alias("ghost"))
    dealt = rows.unionByName(ghosts).repartition(min(ranges, PARTITIONS), "range")
    order = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), "text")
    n = F.length("text")
    seen = dealt.select("range", "ghost", "id", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next"))
    seen = seen.withColumn("edited", F.when(F.col("ghost") == 0, F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next", F.lit(1), F.floor(n / 2).cast("int")))))
    about = seen.select("range", "row", "ghost", "id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # text and edited text share what stands before the last white space of the part that stays
    stays = F.length(F.regexp_extract(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), r"^([\s\S]*)\s", 1))
    has = F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")).rlike(r"\s")
    cut = seen.withColumn("shared", F.when(F.col("ghost") == 1, F.lit(-1)).when(has, stays).otherwise(F.lit(-1)))
    pieces = cut.select(
        "range", "row",
        F.when(F.col("shared") >= 0, F.split(F.substring("text", F.lit(1), F.col("shared")), r"\s", -1)).otherwise(F.array().cast("array<string>")).alias("both"),
        F.split(F.substring("text", F.col("shared") + 2, F.length("text")), r"\s", -1).alias("own"),
        F.when(F.col("edited").isNotNull(), F.split(F.substring("edited", F.col("shared") + 2, F.length("edited")), r"\s", -1)).otherwise(F.array().cast("array<string>")).alias("new"),
    )
    pieces = pieces.select("range", "row", F.size("both").alias("a"), (F.size("both") + F.size("own")).alias("b"), F.concat("both", "own", "new").alias("all"))
    words = pieces.select("range", "row", "a", "b", F.posexplode_outer("all").alias("at", "word"))
    counted = words.groupBy("range", "row", F.xxhash64("word").alias("token")).agg(F.sum((F.col("at") < F.col("b")).cast("int")).alias("w"), F.sum(((F.col("at") < F.col("a")) | (F.col("at") >= F.col("b"))).cast("int")).alias("v"))
    signed = _signed(counted, ["range", "row"], ["w", "v"])
    # ranges keep their place, so the next row's fingerprint is at hand
    signed = signed.withColumn("following", F.lead("w").over(Window.partitionBy("range").orderBy("row")))
    out = about.where("ghost = 0").join(signed, ["range", "row"])
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.array_join("w", "").alias("fingerprint"), F.array_join("v", "").alias("edited_fingerprint"),
        likeness(F.col("w"), F.col("v")).alias("near_edited"), likeness(F.col("w"), F.col("following")).alias("near_next"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir, "doc_id", "text"))
