"""Dataset building: label stripping, duplicates, overlap between sets, quarantine; names of recorded tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, match_key_lower


def strip_label(option: Column) -> Column:
    """An option without a letter and mark at its beginning, such as `A) `."""
    return F.regexp_replace(option, rf"^[{SPACE}]*[A-Ja-j][).][{SPACE}]+", "")


def drop_duplicates(rows: DataFrame, text_col: str, order: str = "ord") -> DataFrame:
    """The first row of each match key; one minimum per key, then a semi-join, so no key's rows are gathered."""
    keyed = rows.withColumn("__key", match_key_lower(F.col(text_col)))
    first = keyed.groupBy("__key").agg(F.min(order).alias(order))
    return keyed.join(first, ["__key", order], "left_semi").drop("__key")


def drop_overlap(rows: DataFrame, other: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text, as match key, isn't in the other set."""
    theirs = other.select(match_key_lower(F.col(text_col)).alias("__key")).distinct()
    return rows.withColumn("__key", match_key_lower(F.col(text_col))).join(theirs, "__key", "left_anti").drop("__key")


def quarantined(rows: DataFrame, problems: DataFrame, id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Rows without and with a problem; problems: row_id, problem."""
    bad = problems.select(F.col("row_id").alias(id_col)).distinct()
    return rows.join(bad, id_col, "left_anti"), rows.join(bad, id_col, "left_semi")


def task_names(recorded: DataFrame, known: DataFrame, manifest: DataFrame) -> DataFrame:
    """task, state of all names: `scored` (recorded and known, or in the manifest), `orphan` (recorded, unknown)."""
    ours = recorded.intersect(known).union(manifest).distinct().withColumn("state", F.lit("scored"))
    return ours.unionByName(recorded.exceptAll(known).distinct().join(manifest, "task", "left_anti").withColumn("state", F.lit("orphan")))


def macro_mean(scores: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean over groups of a score, each group counting once."""
    return scores.groupBy(*by).agg(F.avg(column).alias("macro"), F.count("*").alias("groups"))
