"""Submissions: checks, and the hourly limit, whose rejected rows don't count."""

from __future__ import annotations

import warnings

import pandas as pd
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LIMIT = 5
HOUR = 3_600_000_000  # microseconds


def clip(c, n: int):
    """Trimmed and cut to n characters; null is empty."""
    return F.left(F.trim(F.coalesce(c, F.lit(""))), F.lit(n))


def checked(rows: DataFrame) -> DataFrame:
    """Clipped fields, and ok: required fields are there and the address looks like one."""
    out = rows
    for name, n in (("name", 120), ("email", 160), ("model_name", 120), ("company", 120), ("notes", 1500)):
        out = out.withColumn(name, clip(F.col(name), n))
    for name in ("company", "notes"):
        out = out.withColumn(name, F.nullif(F.col(name), F.lit("")))
    full = (F.length("name") > 0) & (F.length("email") > 0) & (F.length("model_name") > 0)
    return out.withColumn("ok", full & F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))


def screened(rows: DataFrame, salt: str = "") -> DataFrame:
    """Submissions as they are stored, with `said`: why one isn't, null if it is. A filled hidden field is a robot's, consent must
    be given, the sender's address is kept as a salted hash of the first one forwarded.

    rows: id, created_at, name, email, model_name, company, notes, website, consent, forwarded_for.
    """
    address = F.trim(F.get(F.split(F.coalesce("forwarded_for", F.lit("")), ","), F.lit(0)))
    out = checked(rows).withColumn("ip_hash", F.sha2(F.concat(address, F.lit(salt)), 256))
    full = (F.length("name") > 0) & (F.length("email") > 0) & (F.length("model_name") > 0)
    said = F.when(clip(F.col("website"), 200) != "", "robot").when(~F.coalesce("consent", F.lit(False)), "no consent").when(~full, "missing fields").when(~F.col("ok"), "invalid address")
    return out.select("id", "created_at", "name", "email", "model_name", "company", "notes", "ip_hash", said.alias("said"))


def submission_sink(folder: str, limit: int = LIMIT, salt: str = "", notify=None):
    """foreachBatch sink: submissions that pass the checks and the hourly limit as Parquet, one folder per batch, so a repeated
    batch is stored once. notify(rows) gets what was stored; that it fails changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fine = screened(batch, salt).where("said is null").drop("said").dropDuplicates(["id"])
        events = fine.select(F.col("ip_hash").alias("key"), F.xxhash64("id").alias("event_id"), F.col("created_at").alias("ts"))
        try:
            stored = spark.read.parquet(folder).where(F.col("epoch") < epoch)
        except AnalysisException as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        if stored is not None:
            since = events.agg(F.min("ts") - F.expr("INTERVAL 1 HOUR")).scalar()
            # what was stored in the hour before the batch counts, older rows can't matter
            old = stored.where(F.col("created_at") >= since)
            events = events.unionByName(old.select(F.col("ip_hash").alias("key"), F.xxhash64("id").alias("event_id"), F.col("created_at").alias("ts")))
        passed = accepted(events, limit).where("ok").select(F.col("key").alias("ip_hash"), "event_id")
        kept = fine.withColumn("event_id", F.xxhash64("id")).join(passed, ["ip_hash", "event_id"], "left_semi").drop("event_id")
        kept.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        if notify is not None:
            try:
                notify(spark.read.parquet(f"{folder}/epoch={epoch}"))
            except Exception as e:  # noqa: BLE001  a message that isn't sent loses no submission
                warnings.warn(f"no notification: {e}", stacklevel=1)

    return write


def accepted(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, event_id, ok: an event is rejected if its key has `limit` accepted ones in the hour before it. events: key,
    event_id, ts. A key's events go through one task in order of time, as a stream: no more than `limit` times are held."""

    def run(batches):
        key, kept = None, []
        for batch in batches:
            ok = []
            for own, ts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != key:
                    key, kept = own, []
                if ts is None:  # without a time nothing can be accepted
                    ok.append(False)
                    continue
                kept = [x for x in kept if x >= ts - HOUR]
                ok.append(len(kept) < limit)
                if ok[-1]:
                    kept.append(ts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["key", "event_id", "ok"])

    rows = events.select("key", F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInArrow(run, "key string, event_id bigint, ok boolean")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _judged(events: DataFrame, limit: int, delay: str, carried: tuple[str, ...]) -> DataFrame:
    """ts (microseconds), event_id, key, the carried columns and ok of a stream with key, event_id, ts and string columns."""
    found = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if "RocksDB" not in found:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    names = ["ts", "event_id", "key", *carried]
    state = ", ".join(["ts bigint", "event_id bigint", *[f"`{c}` string" for c in names[2:]]])

    # a class of the function travels by value: tasks needn't have this package
    class LastHour(StatefulProcessor):
        """Of each key the events that wait for the watermark, and the times of the accepted ones that still count."""

        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", state)
            self.counted = handle.getListState("counted", "ts bigint")

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for batch in rows:
                timed = batch["ts"].notna()
                if not timed.all():  # without a time nothing can be accepted
                    yield batch.loc[~timed, names].assign(ok=False)
                    batch = batch[timed]
                if len(batch):
                    strings = [[None if pd.isna(x) else x for x in batch[c]] for c in names[2:]]
                    times = batch["ts"].astype("int64").tolist()
                    self.waiting.appendList(list(zip(times, batch["event_id"].astype("int64").tolist(), *strings)))
                    first = min(times) if first is None else min(first, *times)
            if first is not None:
                self.handle.registerTimer(first // 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            kept, due, later = [x[0] for x in self.counted.get()], {}, []
            for x in map(tuple, self.waiting.get()):
                if x[0] < passed:
                    due.setdefault(x[:2], x)
                else:
                    later.append(x)
            said = []
            for at in sorted(due):
                kept = [x for x in kept if x >= at[0] - HOUR]
                said.append((*due[at], len(kept) < limit))
                if said[-1][-1]:
                    kept.append(at[0])
            kept = [x for x in kept if x >= passed - HOUR]
            for state, rest in ((self.waiting, later), (self.counted, [(x,) for x in kept])):
                if rest:
                    state.put(rest)
                else:
                    state.clear()
            if later:
                self.handle.registerTimer(min(x[0] for x in later) // 1000)
            elif kept:  # wakes up once more, to forget the key
                self.handle.registerTimer((kept[-1] + HOUR) // 1000 + 1)
            if said:
                yield pd.DataFrame(said, columns=[*names, "ok"])

        def close(self) -> None:
            pass

    ts = F.col("ts").cast("timestamp")
    # watermarks begin with 1970, times of pandas end with 2262
    rows = events.withColumn("ts", F.when((F.unix_micros(ts) > 0) & (F.year(ts) <= 2200), ts)).withWatermark("ts", delay)
    rows = rows.select(F.coalesce(F.concat(F.lit("k"), F.col("key")), F.lit("")).alias("of"), F.unix_micros("ts").alias("ts"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(0)).alias("event_id"), "key", *carried, F.col("ts").alias("at"))
    return rows.groupBy("of").transformWithStateInPandas(LastHour(), f"{state}, ok boolean", "Append", "EventTime")


def accepted_stream(events: DataFrame, limit: int = LIMIT, delay: str = "10 minutes") -> DataFrame:
    """`accepted` for a stream: an event is judged when the watermark passes it, after all events before it, in whatever order
    they came. One that comes more than `delay` after the latest is dropped, and so is a repeated one. The state of a key is
    `limit` times and the events of its last `delay`; a timer takes it away an hour after the last accepted one. Events of
    equal key, time and id are one event; those without a time, or with one up to 1970 or after 2200, are rejected each time that
    they come, those without an id have the id 0.

    State needs the RocksDB provider: spark.sql.streaming.stateStore.providerClass.
    """
    return _judged(events, limit, delay, ()).select("key", "event_id", "ok")


def submissions_stream(rows: DataFrame, limit: int = LIMIT, delay: str = "1 minute", salt: str = "") -> DataFrame:
    """Submissions of a stream that pass the checks and the hourly limit, as `submission_sink` stores them; nothing that is stored is
    read back. rows: those of `screened`."""
    fine = screened(rows, salt).where("said is null").withColumns({"key": F.col("ip_hash"), "event_id": F.xxhash64("id"), "ts": F.col("created_at")})
    passed = _judged(fine, limit, delay, ("id", "name", "email", "model_name", "company", "notes")).where("ok")
    return passed.select("id", F.timestamp_micros("ts").alias("created_at"), "name", "email", "model_name", "company", "notes", F.col("key").alias("ip_hash"))
