"""Validity intervals from an unbounded stream of assertions: keyed state, one row for each interval that ends."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity string, source string, seq long, value long, valid_from long, valid_until long, status string"
STATE = "seq long, value long, since long, last long"


def stream_intervals(assertions: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """(entity, source, seq, value, valid_from, valid_until, status) of a stream with id, entity, source, value and t (microseconds).

    CLOSED rows are intervals that another value has ended. An assertion from before the last one seen of its chain is LATE: it
    changes nothing and is handed on for inspection instead of being dropped. Within a micro-batch events are put in order; open intervals
    stay in the state. With ``watermark`` a chain without events for that long (by the column ``time``) ends: its open interval is
    handed on as OPEN and its state is freed.
    """
    rows = assertions.withColumns({"entity": F.col("entity").cast("string"), "source": F.col("source").cast("string")})
    if watermark:
        rows = rows.withWatermark(time, watermark)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, value, since, _ = state.get
            state.remove()
            yield pd.DataFrame([(*key, seq, value, since, None, "OPEN")], columns=OUT_COLUMNS)
            return
        seq, value, since, last = state.get if state.exists else (0, None, None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(["t", "id"]).itertuples():
            if last is not None and row.t < last:
                out.append((*key, None, row.value, row.t, None, "LATE"))
                continue
            last = row.t
            if value is None or row.value != value:
                if value is not None:
                    out.append((*key, seq, value, since, row.t, "CLOSED"))
                seq, value, since = seq + 1, row.value, row.t
        state.update((int(seq), int(value), int(since), int(last)))
        if watermark:
            state.setTimeoutTimestamp(max(int(last // 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=OUT_COLUMNS).astype({"seq": "Int64", "valid_until": "Int64"})

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return rows.groupBy("entity", "source").applyInPandasWithState(run, OUT, STATE, "append", timeout)


OUT_COLUMNS = ["entity", "source", "seq", "value", "valid_from", "valid_until", "status"]


def replay_files(spark: SparkSession, sf_dir: str, out: str, checkpoint: str) -> DataFrame:
    """Stream the table ``events`` once through ``stream_intervals`` into Parquet and read that.

    Started again with the same folders it goes on where it stopped.
    """
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder, name = str(Path(source).parent), Path(source).name
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if "://" not in source else spark.readStream.schema(schema).parquet(source)
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("event_type").alias("source"), (k % 4).alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    query = stream_intervals(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(out)


def append_scores(rows: DataFrame, cache, checkpoint: str):
    """Write a stream of (key, value) to a ``KeyedCache``, only keys that are not there yet."""

    def write(batch: DataFrame, _: int) -> None:
        cache.append(batch.dropDuplicates(["key"]).join(cache.read().select("key"), "key", "left_anti"))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
