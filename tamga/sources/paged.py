"""A Python data source for tables that a server hands out page by page, and the reader for hub ids that is built on it.

The server answers `{endpoint}/rows?dataset=&config=&split=&revision=&offset=&length=` with
`{"rows": [{"row_idx": n, "row": {...}}, ...], "num_rows_total": N}`, as public dataset servers do.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import readers
from .providers import RETRYABLE

#: The endpoint of hub ids: this variable, or the public server.
ENDPOINT = ("TAMGA_HUB", "https://datasets-server.huggingface.co")
#: Rows that one hash of a part covers.
HASHED = 4096
ASKED = ("dataset", "config", "split", "revision")


def fetched(url: str, tries: int = 5, pause: float = 1.0, timeout: float = 60.0) -> dict:
    """The JSON at an address; passing errors are tried again after a growing, jittered pause."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as got:
                return json.load(got)
        except (OSError, ValueError) as e:  # refused, cut off, or half an answer
            said = f"HTTP {e.code}: {e.reason}" if isinstance(e, urllib.error.HTTPError) else f"{type(e).__name__}: {e}"
            passing = not isinstance(e, urllib.error.HTTPError) or any(x in said.lower() for x in RETRYABLE)
            if attempt == tries - 1 or not passing:
                raise RuntimeError(f"{url}: {said}") from None
            time.sleep(pause * min(2**attempt, 30) * random.uniform(0.5, 1.5))
    raise ValueError("tries must be 1 or more")


@dataclass
class Pages(InputPartition):
    """Rows from `begin` up to `end`."""

    begin: int
    end: int


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.asked = {k: options[k] for k in ASKED if options.get(k)}
        self.endpoint = (options.get("endpoint") or ENDPOINT[1]).rstrip("/")
        self.page, self.pages = int(options.get("page", 100)), int(options.get("pages", 50))
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause", 1.0))
        if self.page < 1 or self.pages < 1:
            raise ValueError("page and pages must be 1 or more")

    def at(self, offset: int, length: int) -> dict:
        return fetched(f"{self.endpoint}/rows?{urllib.parse.urlencode({**self.asked, 'offset': offset, 'length': length})}", self.tries, self.pause)

    def partitions(self):
        """One request tells how many rows there are; a partition is a range of them, so a lost task asks for its range again."""
        total, step = int(self.at(0, 1)["num_rows_total"]), self.page * self.pages
        return [Pages(k, min(k + step, total)) for k in range(0, total, step)] or [Pages(0, 0)]

    def read(self, partition):
        """A page that is shorter than asked for is followed up; one without rows before the end, or with other rows than those
        asked for, is an error: no row is left out or doubled in silence."""
        at = partition.begin
        while at < partition.end:
            rows = self.at(at, min(self.page, partition.end - at))["rows"][: partition.end - at]
            if [r["row_idx"] for r in rows] != list(range(at, at + len(rows))) or not rows:
                raise RuntimeError(f"rows from {at} are not what the server gave")
            texts = [json.dumps(r["row"], ensure_ascii=False, sort_keys=True) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(texts, pa.string())], names=["ord", "row"])
            at += len(rows)


class PagedSource(DataSource):
    """ord, row: place and JSON text of each row. Options: endpoint, dataset, config, split, revision; page (rows a request, 100),
    pages (requests a partition, 50), tries (5), pause (seconds before the second try, 1)."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "ord bigint, row string"

    def reader(self, schema):
        return PagedReader(self.options)


def read_hub(spark: SparkSession, source: str, split: str = "test", config: str | None = None, revision: str = "", variants: tuple[str, ...] = (), **options) -> tuple[DataFrame, str]:
    """The rows of a hub id with their place as `ord` (a field of that name gives way), and their hash. Pages are fetched once and
    written to a new folder in shared storage, from which all further work reads. The hash is one over hashes of 4,096 rows each,
    in order, so it doesn't depend on the size of pages or partitions. No rows are an error."""
    spark.dataSource.register(PagedSource)
    path = f"{readers.shared_folder(spark)}/hub-{uuid.uuid4().hex}"
    endpoint = os.environ.get(ENDPOINT[0]) or ENDPOINT[1]
    asked = {"endpoint": endpoint, "dataset": source, "config": config or "default", "split": split, "revision": revision, **{k: str(v) for k, v in options.items()}}
    spark.read.format("paged").options(**asked).load().write.parquet(f"{path}.pages")
    pages = spark.read.parquet(f"{path}.pages")
    if pages.isEmpty():
        raise ValueError(f"{source!r} has no rows")
    own = F.sort_array(F.collect_list(F.struct("ord", F.sha2("row", 256).alias("sha"))))
    parts = pages.groupBy(F.floor(F.col("ord") / HASHED).alias("part")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["sha"]), "\n"), 256).alias("sha"))
    whole = hashlib.sha256()
    for part in parts.orderBy("part").toLocalIterator():
        whole.update(part["sha"].encode())
    pages.select(F.format_string('{"ord": %d, "row": %s}', "ord", "row").alias("value")).write.text(f"{path}.jsonl")
    rows = readers.read_jsonl(spark, f"{path}.jsonl", variants)
    return rows.select(*[F.col("row")[c].alias(c) for c in rows.schema["row"].dataType.names if c != "ord"], "ord"), whole.hexdigest()
