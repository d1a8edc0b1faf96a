"""The record log as a stream: new records update a table of latest records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import latest


def stream_records(spark: SparkSession, folder: str, schema, fmt: str = "json") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(folder)


def latest_stream(stream: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The last record of each key as a running aggregate: state is one record per key, whatever the log's length."""
    others = [c for c in value if c not in order]
    best = stream.groupBy(key).agg(F.max_by(F.struct(*order, *others), F.struct(*order)).alias("x"))
    return best.select(key, *[F.col("x")[c].alias(c) for c in (*order, *others)])


BUCKET, SLOT, EPOCH = "bucket_", "slot_", "epoch_"


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _newest(stored: DataFrame) -> DataFrame:
    """Of each bucket the slot that was written last: a row per bucket."""
    slots = stored.groupBy(BUCKET, SLOT).agg(F.max(EPOCH).alias("e"))
    return slots.groupBy(BUCKET).agg(F.max_by(SLOT, "e").alias(SLOT), F.max("e").alias("e"))


def upsert(folder: str, key: str = "item_id", order: str = "ord", buckets: int = 64):
    """foreachBatch sink: latest records as Parquet, by hash buckets of the key. A batch rewrites the buckets of its keys only.

    Each bucket has two slots. A batch merges the slot that was written last into the other one, by dynamic partition overwrite, so
    what it reads stays until the batch is over, nothing has to be cleared away and a table takes twice its size at most. A batch
    that is repeated starts from the slot before it and gives the same table. read_upserted() reads it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, order).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        stored, slots = _stored(spark, folder), []
        if stored is not None:
            before = stored.where(F.col(BUCKET).isin(touched) & (F.col(EPOCH) < epoch))
            slots = [(r[BUCKET], r[SLOT]) for r in _newest(before).collect()]
        rows = new.withColumn(SLOT, F.lit(1))
        if slots:
            now = spark.createDataFrame(slots, f"{BUCKET} int, {SLOT} int")
            old = stored.where(F.col(BUCKET).isin(touched)).join(F.broadcast(now), [BUCKET, SLOT]).drop(EPOCH)
            rows = new.join(F.broadcast(now), BUCKET, "left").withColumn(SLOT, F.coalesce(SLOT, F.lit(1))).unionByName(old, allowMissingColumns=True)
        merged = latest(rows, key, order)
        put = merged.withColumn(SLOT, 1 - F.col(SLOT)).withColumn(EPOCH, F.lit(epoch).cast("bigint")).repartition(BUCKET)
        put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, SLOT).parquet(folder)

    return write


def read_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """The table that upsert() keeps."""
    stored = spark.read.parquet(folder)
    return stored.join(F.broadcast(_newest(stored).drop("e")), [BUCKET, SLOT]).drop(BUCKET, SLOT, EPOCH)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through a memory table; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
