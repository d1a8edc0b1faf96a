"""The append-only record log: latest records, resume, rescore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import NON_SCORING, scorable


def latest(log: DataFrame, key: str = "item_id", order: str = "ord") -> DataFrame:
    """The last record of each item, whatever its status (rescoring). One max per key, so it combines before the shuffle."""
    others = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x"))
    return best.select(key, *[F.col("x")[c].alias(c) for c in others])


def latest_non_error(log: DataFrame, key: str = "item_id", order: str = "ord") -> DataFrame:
    """The last record of each item that is no error (resume)."""
    return latest(log.where(F.col("status").isNull() | (F.col("status") != "error")), key, order)


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    return items.join(done.select("item_id"), "item_id", "left_anti")


def completed(items: DataFrame, done: DataFrame) -> DataFrame:
    return done.join(items.select("item_id"), "item_id", "left_semi")


def rescore(log: DataFrame, items: DataFrame, parse, score) -> DataFrame:
    """Latest records of known items, parsed and scored anew; records of failed requests stay as they are.

    parse(response, items' columns) and score(extraction) are Column builders over the joined row.
    """
    met = latest(log).withColumnRenamed("ord", "log_ord").join(items, "item_id")
    x = parse(met).alias("x")
    met = met.withColumn("x", F.when(F.col("status") != "error", x))
    fine = (F.col("x.status") == "ok") & F.col("x.value").isNotNull()
    new = F.when(fine, score(met)).otherwise(0.0)
    keep = F.col("status") == "error"
    out = met.withColumn("score", F.when(keep, F.coalesce("score", F.lit(0.0)) if "score" in met.columns else F.lit(0.0)).otherwise(new))
    for name, field in (("extracted", "value"), ("strategy", "strategy"), ("evidence", "evidence")):
        out = out.withColumn(name, F.when(~keep, F.col(f"x.{field}")))
    return out.withColumn("status", F.when(keep, F.lit("error")).otherwise(F.col("x.status"))).drop("x")


def diagnostics(results: DataFrame, *by: str) -> DataFrame:
    """n_items, n_scored and rates by status; rates unrounded."""
    n = F.count("*")
    rate = lambda s: (F.count_if(F.col("status") == s) / n).alias(f"{s}_rate")
    scored = F.count_if(scorable(F.col("status")))
    return results.groupBy(*by).agg(n.alias("n_items"), scored.alias("n_scored"), *[rate(s) for s in (*NON_SCORING, "refusal")], (scored / n).alias("coverage"))


def strategies(results: DataFrame, *by: str) -> DataFrame:
    """Histogram of strategies, most frequent first, then first seen."""
    counts = results.where(F.length(F.coalesce("strategy", F.lit(""))) > 0).groupBy(*by, "strategy").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counts.withColumn("position", F.row_number().over(order)).drop("first")


def at_or_below_chance(primary: Column, chance: Column) -> Column:
    return F.when(chance != 0, primary <= chance * 100)
