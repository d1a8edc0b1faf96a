"""Sinks: the record log, manifests, the leaderboard document, worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_records(records: DataFrame, folder: str, run_id: str, task: str) -> None:
    """Append records of one run and task as JSON lines under run_id=/task=; a commit is whole or not there."""
    records.withColumn("run_id", F.lit(run_id)).withColumn("task", F.lit(task)).write.mode("append").partitionBy("run_id", "task").json(folder)


def write_document(rows: DataFrame, path: str) -> None:
    """Rows as one JSON-lines file; for documents of a few rows, such as a leaderboard or a manifest."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_board(document: DataFrame, suite: str, path: str) -> None:
    """One JSON document: suite, when it was made, and the models' rows in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("r"), "model", "row"))), lambda x: x.row)
    whole = document.agg(F.concat(F.lit(f'{{"suite":"{suite}","generatedAt":"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit('","models":['), F.array_join(ordered, ","), F.lit("]}")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_worklist(missing: DataFrame, path: str) -> None:
    missing.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
