"""Aggregates over item results: accuracy with intervals, breakdowns, paired tests, resampling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import scorable
from ..functions.mt import bleu_score, bleu_statistics, chrf_score, chrf_statistics
from ..functions.seeded import draws
from ..functions.stats import mcnemar, percent, py_round, wilson


def accuracy(results: DataFrame, *by: str, only_scorable: bool = True) -> DataFrame:
    """accuracy, ci_low, ci_high in percent, n and correct of the scorable rows; coverage over all. Unrounded.

    Groups without a scorable row have zeros. The sum of scores is taken in one pass, partial sums first.
    """
    use = scorable(F.col("status")) if only_scorable else F.lit(True)
    sums = results.groupBy(*by).agg(F.count_if(use).alias("n"), F.coalesce(F.sum(F.when(use, F.col("score"))), F.lit(0.0)).cast("double").alias("correct"), F.count("*").alias("n_items"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return sums.select(*by, percent(F.col("correct"), F.col("n")).alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"), "n", "n_items", "correct", (F.col("n") / F.col("n_items")).alias("coverage"))


def breakdown(results: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """One row per key and value: each key by itself, missing values as `unknown`. One pass over the results."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in keys])
    each = results.select(*by, "status", "score", F.explode(pairs).alias("x")).select(*by, "status", "score", "x.key", "x.value")
    return accuracy(each, *by, "key", "value")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """item_id, a, b of two score tables; items on one side only are an error when rows are read."""
    met = a.select("item_id", F.col("score").alias("a")).join(b.select("item_id", F.col("score").alias("b")), "item_id", "full_outer")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    return met.withColumn("a", F.when(whole, F.col("a")).otherwise(F.raise_error(F.lit("a paired test needs the same items on both sides")).cast("double")))


def mcnemar_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """b (a right, b wrong) and c (the reverse)."""
    return pairs.groupBy(*by).agg(F.count_if((F.col("a") > 0) & (F.col("b") <= 0)).alias("b"), F.count_if((F.col("b") > 0) & (F.col("a") <= 0)).alias("c"))


def mcnemar_test(pairs: DataFrame, *by: str) -> DataFrame:
    return mcnemar_counts(pairs, *by).withColumn("t", mcnemar(F.col("b"), F.col("c"))).select(*by, "b", "c", "t.*")


# Cumulative probabilities of Poisson(1).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
#: Rows whose weights a task holds at a time.
WEIGHED = 1024


def placed(rows: DataFrame, column: str) -> DataFrame:
    """rows with `pos`, their rank by a column from 0, without a window over all of them: cuts taken from rows picked by hash divide
    them into stretches, whose sizes are added up."""
    cuts = max(1, min(4096, rows.count() // 50_000))
    picked = sorted(r[0] for r in rows.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(16 * cuts).collect())[8::16]
    kind = rows.schema[column].dataType
    part = sum(((F.col(column) >= F.lit(x).cast(kind)).cast("int") for x in picked), F.lit(0)) if len(picked) < 64 else F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in picked]), lambda x: x <= F.col(column)))
    dealt = rows.withColumn("__part", F.coalesce(part, F.lit(0)))
    counts = dict(dealt.groupBy("__part").agg(F.count("*")).collect())
    before, start = {}, 0
    for k in sorted(counts):
        before[k], start = start, start + counts[k]
    if not before:
        return rows.withColumn("pos", F.lit(0).cast("bigint"))
    starts = F.create_map(*[F.lit(x).cast("bigint") for k in before.items() for x in k])
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return dealt.withColumn("pos", rank + F.element_at(starts, F.col("__part").cast("bigint"))).drop("__part")


def _summed(held: dict, by: list[pa.Field], values: list[str]) -> pa.RecordBatch:
    """by, sample and sums of each group that a task has met, its samples one after the other."""
    keys = list(held)
    samples = len(next(iter(held.values())))
    columns = [pa.array([k[i] for k in keys for _ in range(samples)], f.type) for i, f in enumerate(by)]
    columns.append(pa.array(np.tile(np.arange(samples, dtype=np.int32), len(keys))))
    sums = np.concatenate([held[k] for k in keys])
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(sums[:, v])) for v in range(len(values)))], names=[*(f.name for f in by), "sample", *values])


def _add(held: dict, by: list[list], values: np.ndarray, weights: np.ndarray) -> None:
    """weights: rows x samples. One product of matrices for each group."""
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*by) if by else [()] * len(values)):
        groups.setdefault(key, []).append(i)
    for key, rows in groups.items():
        sums = weights[rows].T.astype(np.float64) @ values[rows]
        held[key] = held[key] + sums if key in held else sums


def _schema(rows: DataFrame, by: list[str], values: list[str]) -> tuple[str, list[pa.Field]]:
    kinds = [(c, rows.schema[c].dataType) for c in by]
    text = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds), "sample int", *(f"`{c}` double" for c in values)])
    return text, [pa.field(c, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t.simpleString()]) for c, t in kinds]


def hashed_weights(ids: list, samples: int, seed: int) -> np.ndarray:
    """How often each id is drawn for each sample: Poisson(1) by hash, a bootstrap without sequential state. Samples are told apart
    by the first 32 bits of md5(seed|id|sample)."""
    ends = [str(s).encode() for s in range(samples)]
    out = np.empty((len(ids), samples), np.uint32)
    for i, x in enumerate(ids):
        begun = hashlib.md5(f"{seed}|{x}|".encode(), usedforsecurity=False)
        row = []
        for end in ends:
            h = begun.copy()
            h.update(end)
            row.append(h.digest()[:4])
        out[i] = np.frombuffer(b"".join(row), ">u4")
    return np.searchsorted(np.array(POISSON), out / 4294967296.0, side="right")


def resampled_hashed(rows: DataFrame, by: list[str], values: list[str], samples: int, seed: int = 0, id_col: str = "item_id") -> DataFrame:
    """by, sample and sums of the values, each row as often as its hash says. A task adds up a vector of all samples for each
    group, so what is shuffled are vectors of tasks and not rows by samples. There should be few groups."""
    schema, fields = _schema(rows, by, values)

    def run(batches):
        held: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, WEIGHED):
                batch = whole.slice(at, WEIGHED)
                numbers = np.stack([batch.column(1 + len(by) + v).to_numpy(zero_copy_only=False) for v in range(len(values))], 1)
                _add(held, [batch.column(1 + i).to_pylist() for i in range(len(by))], numbers, hashed_weights(batch.column(0).to_pylist(), samples, seed))
        if held:
            yield _summed(held, fields, values)

    made = rows.select(F.col(id_col).cast("string"), *by, *[F.col(c).cast("double") for c in values]).mapInArrow(run, schema)
    return made.groupBy(*by, "sample").agg(*[F.sum(c).alias(c) for c in values])


def resampled_seeded(rows: DataFrame, by: list[str], values: list[str], n: int, samples: int, seed: int) -> DataFrame:
    """by, sample and sums of the values, each position `pos` (0 to n - 1) as often as random.Random(seed) draws it: samples of n
    draws, one after the other. Draws are made in parts and meet the rows of their block of positions; see functions.seeded."""
    schema, fields = _schema(rows, by, values)
    drawn, block = draws(rows.sparkSession, n, samples, seed)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        weights = np.zeros((block, samples), np.int32)
        for sample, places in zip(right.column("sample").to_pylist(), right.column("places").to_pylist()):
            weights[:, sample] += np.bincount(np.frombuffer(places, "<i4"), minlength=block).astype(np.int32)
        held: dict = {}
        numbers = np.stack([left.column(c).to_numpy() for c in values], 1)
        _add(held, [left.column(c).to_pylist() for c in by], numbers, weights[left.column("pos").to_numpy() % block])
        return pa.Table.from_batches([_summed(held, fields, values)]) if held else pa.Table.from_batches([], schema=pa.schema([*fields, ("sample", pa.int32()), *((c, pa.float64()) for c in values)]))

    dealt = rows.select(F.floor(F.col("pos") / block).alias("block"), "pos", *by, *[F.col(c).cast("double").alias(c) for c in values])
    made = dealt.groupBy("block").cogroup(drawn.groupBy("block")).applyInArrow(run, schema)
    return made.groupBy(*by, "sample").agg(*[F.sum(c).alias(c) for c in values])


def paired_bootstrap(pairs: DataFrame, samples: int = 1000, seed: int = 12345) -> DataFrame:
    """delta, p_value: one row. pairs: ord, a, b; positions are ranks of ord."""
    spark = pairs.sparkSession
    told = placed(pairs.select("ord", (F.col("a") - F.col("b")).alias("d")), "ord")
    whole = told.agg(F.count("*").alias("n"), F.sum("d").alias("d")).first()
    n = whole["n"]
    if not n:
        return spark.createDataFrame([(0.0, 1.0, 0)], "delta double, p_value double, n_samples int")
    sums = resampled_seeded(told, [], ["d"], n, samples, seed)
    same = (F.col("d") > 0) == F.lit(whole["d"] > 0)
    return sums.agg(F.lit(whole["d"] / n * 100).alias("delta"), (F.lit(1.0) - F.count_if(same & (F.col("d") != 0)) / samples).alias("p_value"), F.lit(samples).alias("n_samples"))


def paired_bootstrap_hashed(pairs: DataFrame, samples: int = 200, seed: int = 12345) -> DataFrame:
    """sample, delta: mean difference of each hash-drawn resample; one that draws nothing has none."""
    rows = pairs.select("item_id", (F.col("a") - F.col("b")).alias("d"), F.lit(1.0).alias("n"))
    sums = resampled_hashed(rows, [], ["d", "n"], samples, seed)
    return sums.where("n > 0").select("sample", (F.col("d") / F.col("n")).alias("delta"))


def interval(values: DataFrame, column: str) -> DataFrame:
    """low, high: the values at positions int(0.025 n) and min(n - 1, int(0.975 n)) of the sorted column.

    Equal values are counted first, and the counts are added up by ranges of values, so no task sees the whole column.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    cuts = values.select(F.percentile_approx(F.col(column).cast("double"), [k / 64 for k in range(1, 64)], 1000)).scalar()
    dealt = counts.withColumn("cuts", cuts).select("v", "c", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < F.col("v").cast("double"))).alias("part"))
    below = dealt.groupBy("part").agg(F.sum("c").alias("sum"))
    below = below.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("n"))  # 64 rows
    placed = dealt.join(F.broadcast(below), "part").withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    at = lambda q: F.floor(F.lit(q) * F.col("n")).cast("bigint")
    has = lambda k: (F.col("end") > k) & (F.col("end") - F.col("c") <= k)
    return placed.agg(F.max(F.when(has(at(0.025)), F.col("v"))).alias("low"), F.max(F.when(has(F.least(F.col("n") - 1, at(0.975))), F.col("v"))).alias("high"))


def chrf_interval(pairs: DataFrame, samples: int = 500, seed: int = 12345) -> DataFrame:
    """95 % interval of corpus chrF++ by resampling segments."""
    return _resampled(pairs, chrf_statistics, chrf_score, "chrf", samples, seed)


def bleu_interval(pairs: DataFrame, samples: int = 500, seed: int = 12345) -> DataFrame:
    """95 % interval of corpus BLEU by resampling segments."""
    return _resampled(pairs, bleu_statistics, bleu_score, "bleu", samples, seed)


def _resampled(pairs: DataFrame, statistics, scored, column: str, samples: int, seed: int) -> DataFrame:
    """The statistics of the segments are made once and summed per resample."""
    segments = placed(pairs.select("seg"), "seg")
    n = segments.count()
    if n < 2:
        return pairs.sparkSession.createDataFrame([(0.0, 0.0)], "low double, high double")
    sums = resampled_seeded(statistics(pairs).join(segments, "seg"), ["kind", "n"], ["hyp", "ref", "match"], n, samples, seed)
    return interval(scored(sums, "sample"), column)


def segment_interval(segments: DataFrame, samples: int = 500, seed: int = 12345) -> DataFrame:
    """95 % interval of corpus chrF++ by resampling segments (seg, stats: an array of statistics). Scores of the resamples are
    rounded to two digits. Fewer than two segments have 0 and 0."""
    told = placed(segments, "seg")
    n = segments.count()
    if n < 2:
        return segments.sparkSession.createDataFrame([(0.0, 0.0)], "low double, high double")
    each = told.select("pos", F.explode("stats").alias("x")).select("pos", "x.*").where("kind <> 'b'")
    sums = resampled_seeded(each, ["kind", "n"], ["hyp", "ref", "match"], n, samples, seed)
    return interval(chrf_score(sums, "sample").withColumn("chrf", py_round(F.col("chrf"), 2)), "chrf")


def constraint_summary(judged: DataFrame) -> DataFrame:
    """One row: prompt and instruction rates, strict and loose, coverage. judged: item_id, outcome, strict, loose."""
    each = judged.groupBy("item_id").agg(
        F.count("*").alias("all"), F.count_if(F.col("outcome") != "excluded").alias("n"), F.count_if("strict").alias("s"), F.count_if("loose").alias("l")
    )
    some = F.col("n") > 0
    out = each.agg(
        F.count_if(some).alias("n"), F.count_if(some & (F.col("s") == F.col("n"))).alias("ps"), F.count_if(some & (F.col("l") == F.col("n"))).alias("pl"),
        F.sum("n").alias("evaluated"), F.sum("all").alias("all"), F.sum("s").alias("is"), F.sum("l").alias("il"),
    )
    low, high = wilson(F.col("ps"), F.col("n"))
    return out.select(
        percent(F.col("ps"), F.col("n")).alias("prompt_strict"), low.alias("ci_low"), high.alias("ci_high"), percent(F.col("pl"), F.col("n")).alias("prompt_loose"),
        percent(F.col("is"), F.col("evaluated")).alias("inst_strict"), percent(F.col("il"), F.col("evaluated")).alias("inst_loose"), "n",
        F.col("evaluated").alias("constraints_evaluated"), (F.col("all") - F.col("evaluated")).alias("constraints_excluded"), percent(F.col("evaluated"), F.col("all")).alias("coverage_percent"),
    )


def by_instruction(judged: DataFrame, least: int = 15) -> DataFrame:
    """Rates per instruction with at least so many judged constraints."""
    some = judged.where("outcome <> 'excluded'").groupBy("name").agg(F.count("*").alias("n"), F.count_if("strict").alias("s"), F.count_if("loose").alias("l")).where(F.col("n") >= least)
    return some.select("name", "n", percent(F.col("s"), F.col("n")).alias("strict"), percent(F.col("l"), F.col("n")).alias("loose"))


def exclusion_reasons(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def replicates(scores: DataFrame) -> DataFrame:
    """model, task, mean, low, high, runs of repeated runs."""
    return scores.groupBy("model", "task").agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("runs"))


def recall_gap(results: DataFrame, recall: str, choice: str) -> DataFrame:
    """model, recall, choice, gap over items that both tasks scored."""
    a = results.where(F.col("task") == recall).select("model", "item_id", F.col("score").alias("r"))
    b = results.where(F.col("task") == choice).select("model", "item_id", F.col("score").alias("c"))
    both = a.join(b, ["model", "item_id"])
    return both.groupBy("model").agg((F.avg("r") * 100).alias("recall"), (F.avg("c") * 100).alias("choice"), ((F.avg("c") - F.avg("r")) * 100).alias("gap"), F.count("*").alias("n"))


def share(c: Column) -> Column:
    return F.avg(c.cast("int"))
