"""Dataset readers: JSON, JSON lines, CSV, TSV, Parquet and what is registered."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.parse
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRAPPERS = ("data", "rows", "items", "examples")
READERS: dict = {}


@dataclass(frozen=True)
class Dataset:
    """A dataset and where it came from."""

    id: str
    rows: DataFrame
    sha256: str
    source: str
    revision: str = ""
    placed: bool = False  # rows hold their place as `ord`


def register_reader(suffix: str):
    """Register a function (spark, path) -> DataFrame for a file suffix; a suffix can be taken once."""

    def put(f):
        if suffix in READERS:
            raise ValueError(f"there is a reader for {suffix!r} already")
        READERS[suffix] = f
        return f

    return put


def get_reader(suffix: str):
    if suffix.lower() not in READERS:
        raise ValueError(f"no reader for {suffix!r}; there are {', '.join(sorted(READERS))}")
    return READERS[suffix.lower()]


def _open_typed(kind, names: tuple[str, ...]):
    """A schema in which fields of these names are VARIANT, wherever they stand."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, T.VariantType() if f.name in names else _open_typed(f.dataType, names), f.nullable) for f in kind.fields])
    return T.ArrayType(_open_typed(kind.elementType, names)) if isinstance(kind, T.ArrayType) else kind


def _json(reader, path: str, variants: tuple[str, ...]) -> DataFrame:
    """With columns whose values have types of their own, row by row, as VARIANT: inference would make strings of them."""
    df = reader.json(path)
    schema = _open_typed(df.schema, variants)
    return reader.schema(schema).json(path) if schema != df.schema else df


@register_reader(".json")
def read_json(spark: SparkSession, path: str, variants: tuple[str, ...] = ()) -> DataFrame:
    """A list of objects, an object that has the list under data, rows, items or examples, or one object. Of several files all
    fields are kept. A byte-order mark at the beginning is skipped. A JSON document is read by one task: corpora come as JSON
    lines or Parquet."""
    df = _json(spark.read.option("multiLine", True).option("mode", "FAILFAST").option("allowNumericLeadingZeros", True), path, variants)
    for name in WRAPPERS:
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            return df.select(F.inline(name)) if df.schema[name].dataType.elementType.typeName() == "struct" else df
    return df


@register_reader(".jsonl")
def read_jsonl(spark: SparkSession, path: str, variants: tuple[str, ...] = ()) -> DataFrame:
    """One object per line; blank lines are skipped."""
    return _json(spark.read.option("mode", "FAILFAST"), path, variants)


@register_reader(".csv")
def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """With a header; all columns are strings. Spark's parser skips a byte-order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep, inferSchema=False)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


@register_reader(".tsv")
def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


@register_reader(".parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def resolve(source: str, roots: tuple[str, ...] = ()) -> str | None:
    """A local file for a reference: as given, then under each root; None for a hub id or a URL. A reference that looks like a
    file but isn't there is an error."""
    if "://" in source:
        return None
    for base in ("", os.getcwd(), *roots):
        path = os.path.join(base, os.path.expanduser(source))
        if os.path.isfile(path) or os.path.isdir(path) and source.endswith(".parquet"):
            return os.path.abspath(path)
    suffix = os.path.splitext(source)[1]
    if not suffix and source.count("/") == 1 and not source.startswith("."):
        return None
    if not suffix and "/" not in source:
        return None
    raise FileNotFoundError(f"{source!r} is not in {', '.join(['.', *roots])}")


#: Bytes of a file that a task takes as one value.
WHOLE_FILE = 1 << 30


def _local_sha256(batches):
    for batch in batches:
        out = []
        for name in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with open(urllib.parse.unquote(urllib.parse.urlparse(name).path), "rb") as f:
                while piece := f.read(1 << 22):
                    digest.update(piece)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "sha"])


def file_sha256(spark: SparkSession, path: str) -> str:
    """Hash of a file's bytes; of a folder, of its files' hashes by name. Tasks read the files, one file a task: as streams where they
    have paths of the file system, else whole through Spark. What is neither, a file beyond 1 GB in a store that only Spark
    reaches, is an error: hash it where it is stored, and give the hash as the revision."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select("path", "length").collect()
    if all(r["path"].startswith("file:") for r in listed):
        names = spark.createDataFrame([(r["path"],) for r in listed], "path string")
        found = names.repartition(max(1, len(listed))).mapInArrow(_local_sha256, "path string, sha string")
    elif all(r["length"] <= WHOLE_FILE for r in listed):
        found = files.select("path", F.sha2("content", 256).alias("sha"))
    else:
        raise ValueError(f"{path!r} has files beyond {WHOLE_FILE} bytes that tasks can't open")
    hashes = sorted((r["path"], r["sha"]) for r in found.collect())
    return hashes[0][1] if len(hashes) == 1 else hashlib.sha256("\n".join(x for _, x in hashes).encode()).hexdigest()


def load(spark: SparkSession, source: str, roots: tuple[str, ...] = (), revision: str = "", variants: tuple[str, ...] = (), split: str = "test", config: str | None = None) -> Dataset:
    """A dataset by file, or a split of a hub id, page by page; a reader registered for `hub` goes before the pages. Empty ones are an
    error. variants: columns of JSON whose values differ in type from row to row."""
    path = resolve(source, roots)
    if path is None and "://" in source:
        path = source
    if path is None:
        origin = f"hub://{source}" + (f"@{revision}" if revision else "")
        if "hub" in READERS:
            return Dataset(source, READERS["hub"](spark, source), "", origin, revision)
        from .paged import read_hub

        rows, sha = read_hub(spark, source, split, config, revision, variants)
        return Dataset(source, rows, sha, origin, revision, True)
    suffix = os.path.splitext(path)[1]
    rows = get_reader(suffix)(spark, path, variants) if variants and suffix.lower() in (".json", ".jsonl") else get_reader(suffix)(spark, path)
    if rows.isEmpty():
        raise ValueError(f"{source!r} has no rows")
    return Dataset(source, rows, file_sha256(spark, path), path, revision)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master without one, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base or tempfile.mkdtemp(prefix="tamga-")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A record log; lines that can't be parsed are dropped, unknown fields too. `ord` follows file and place in it."""
    from ..operators.items import numbered
    from .schemas import RECORD

    return numbered(spark.read.option("mode", "DROPMALFORMED").schema(RECORD).json(path)).where("item_id is not null")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run manifests under folder: run_id, model, times, path, tasks (names), manifest (as text). Files that can't be parsed
    are skipped."""
    files = spark.read.text(f"{folder}/*/manifest.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    schema = "run_id string, model string, organization string, license string, weights_url string, quantization string, reasoning string, harness_version string, harness_git_sha string, temperature double, started_at string, finished_at string, tasks map<string,string>"
    parsed = files.select("path", "value", F.from_json("value", schema).alias("m")).where("m.model is not null or m.run_id is not null")
    return parsed.select("path", "m.*", F.col("value").alias("manifest")).withColumn("cells", F.col("tasks")).withColumn("tasks", F.map_keys("tasks"))


def run_cells(runs: DataFrame) -> DataFrame:
    """model, run_id, task and the numbers of each task entry with metrics."""
    entry = "metrics struct<primary:double,ci_low:double,ci_high:double>, diagnostics struct<coverage:double,unparsed_rate:double,at_or_below_chance:boolean>, n_items bigint, n_scored bigint, task_version string, dataset_sha256 string, reasoning string"
    each = runs.select("model", "run_id", F.explode("cells").alias("task", "entry")).withColumn("e", F.from_json("entry", entry)).where("e.metrics is not null")
    return each.select("model", "run_id", "task", F.col("e.metrics.primary").alias("score"), "e.metrics.ci_low", "e.metrics.ci_high", F.coalesce("e.diagnostics.coverage", F.lit(1.0)).alias("coverage"), "e.n_items", "e.n_scored", "e.reasoning", F.coalesce("e.diagnostics.unparsed_rate", F.lit(0.0)).alias("unparsed_rate"), F.coalesce("e.diagnostics.at_or_below_chance", F.lit(False)).alias("at_or_below_chance"), "e.task_version", F.left("e.dataset_sha256", F.lit(12)).alias("sha"))
