"""Event-time operators. Each takes a batch or a streaming DataFrame; watermarks have no effect on batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """df with a watermark if it is a stream; times without a zone are taken as the session's there."""
    if not (late and df.isStreaming):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, by: list[str], width: str, late: str | None = None) -> DataFrame:
    """(start, end, by, n) of windows of one width."""
    made = _watermarked(df, ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sliding(df: DataFrame, ts: str, by: list[str], width: str, step: str, late: str | None = None) -> DataFrame:
    made = _watermarked(df, ts, late).groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """(start, end, by, n): runs of events with gaps below gap; end is the last event plus the gap."""
    made = _watermarked(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key: over a stream, duplicates within the watermark are dropped."""
    return _watermarked(df, ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, length): over a stream, for each batch the run of equal values that a key is in at its end.

    State is the last value and the length of its run; a batch's rows count in the order of their arrival.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(df.dtypes)
    out = f"{key} {kinds[key]}, {value} {kinds[value]}, length long"

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        for part in parts:
            for v in part[value]:
                n = n + 1 if v == last else 1
                last = v
        state.update((last, n))
        yield pd.DataFrame({key: [k[0]], value: [last], "length": [n]})

    return df.groupBy(key).applyInPandasWithState(update, out, f"last {kinds[value]}, n long", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Starts a query that keeps, in a folder for each batch, the last row of each key so far; the newest folder is the table.

    A batch that is run again writes the same folder again.
    """
    from braidwork.operators.windows import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}"))
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
