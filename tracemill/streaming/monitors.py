"""Structured Streaming forms of the monitoring operators (M1 to M6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """A file stream of one table; the checkpoint of the query remembers what was read (M4)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder)


def resampled(events: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """M5: count, mean and extremes of tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "low", "high")


def idle_sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """M2: sessions that end after a gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def correlated(calls: DataFrame, kernels: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """M6: calls (key, ts) with kernels (key, ts) that start within an interval after them; both sides forget what is too old."""
    a = calls.withWatermark("ts", late).select(F.col(key).alias("a_key"), F.col("ts").alias("a_ts"), F.col("seq").alias("a_seq"))
    b = kernels.withWatermark("ts", late).select(F.col(key).alias("b_key"), F.col("ts").alias("b_ts"), F.col("seq").alias("b_seq"))
    return a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}")))


def alarms(errors: DataFrame, key: str, limit: float, width: int = 10) -> DataFrame:
    """M1: for each row (key, ts, seq, error) the rolling mean of the last `width` errors of its key and whether it is above the
    limit. The state of a key is its last errors; rows of a batch are taken in the order of ts."""
    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = list(state.get[0]) if state.exists else [], []
        for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            last = [*last, float(r.error)][-width:]
            mean = sum(last) / width if len(last) == width else None
            out.append((k[0], r.seq, mean, int(mean is not None and mean > limit)))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "seq", "rolling", "alarm"])

    kind = errors.schema[key].dataType.simpleString()
    return errors.select(key, "ts", "seq", "error").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, rolling double, alarm int", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def batch_cycles(events: DataFrame, key: str, late: str = "1 hour", patience_ms: int = 3_600_000) -> DataFrame:
    """M3: virtual cycles of a stream of (key, ts, kind run or result, mode). An active run waits for its result; after
    `patience_ms` of event time without one it becomes a prefill."""
    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, active = [], tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((k[0], "prefill", active[0], state.getCurrentWatermarkMs() * 1000))
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
                at = int(r.ts.value // 1000)
                if r.kind == "run":
                    if active and active[1] != r.mode:
                        out.append((k[0], "batch", active[0], at))
                    active = (at, int(r.mode))
                elif active:
                    out.append((k[0], "batch", active[0], at))
                    active = None
            if active:
                state.update(active)
                state.setTimeoutTimestamp(max(active[0] // 1000 + patience_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[key, "kind", "start_us", "end_us"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(key, "ts", "kind", "mode")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, kind string, start_us long, end_us long", "start_us long, mode int", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All output of a stream over what its source holds now. `folder` keeps results and the stream's checkpoint, so it must be shared."""
    sink = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        q = sink.outputMode("append").format("parquet").option("path", f"{folder}/out").start()
    else:
        q = sink.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
