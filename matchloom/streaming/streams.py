"""Structured Streaming forms of ingest, dedup, windows, sessions, silence and incremental maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """Files that land in a folder, as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def ingest_filter(df: DataFrame, kinds: Sequence[str], floor: float, kind: str = "kind", rating: str = "rating") -> DataFrame:
    """Allowed kinds at or over a rating; an unknown rating (null or not over 0) passes."""
    return df.where(F.col(kind).isin(*kinds) & (F.col(rating).isNull() | (F.col(rating) <= 0) | (F.col(rating) >= floor)))


def dedup_stream(df: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each key once although polls overlap; state is dropped after the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def hourly_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def windowed_rate(df: DataFrame, ts: str, failed: str, width: str, slide: str, delay: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and failure ratio in sliding windows."""
    g = df.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr(f"cast({failed} as double)")).alias("ratio")).select(F.col("w.start").alias("start"), *by, "n", "ratio")


def stream_sessions(df: DataFrame, ts: str, entity: str, gap: str, delay: str) -> DataFrame:
    g = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), entity)
    return g.agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def silence(df: DataFrame, ts: str, entity: str, minutes: int, delay: str) -> DataFrame:
    """An alert (entity, last, kind) when an entity's events stop for `minutes` of event time: gaps between events, and a timeout at the end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, limit = [], minutes * 60_000
        if state.hasTimedOut:
            out.append((key[0], pd.Timestamp(state.get[0], unit="ms"), "timeout"))
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for at in sorted(t for b in batches for t in b[ts].astype("datetime64[ms]").astype("int64")):
                if last is not None and at - last > limit:
                    out.append((key[0], pd.Timestamp(last, unit="ms"), "gap"))
                last = max(at, last or at)
            state.update((int(last),))
            state.setTimeoutTimestamp(max(int(last) + limit, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[entity, "last", "kind"])

    kind = dict(df.dtypes)[entity]
    return df.withWatermark(ts, delay).groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, last timestamp, kind string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_tilt(df: DataFrame, entity: str, order: str, lost: str, keep: int, alarm: int) -> DataFrame:
    """After each event of an entity the losses among its last `keep`, and whether that is an alarm; state holds `keep` numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            last = [*last, int(getattr(r, lost))][-keep:]
            out.append((key[0], getattr(r, order), sum(last), sum(last) >= alarm))
        state.update((last,))
        yield pd.DataFrame(out, columns=[entity, order, "losses", "alarm"])

    kinds = dict(df.dtypes)
    return df.groupBy(entity).applyInPandasWithState(step, f"{entity} {kinds[entity]}, {order} {kinds[order]}, losses int, alarm boolean", "last array<int>", "append", GroupStateTimeout.NoTimeout)


def maintain(df: DataFrame, path: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str):
    """Folds each micro-batch into a table at path: fold(batch, state or None) -> state. A batch that is retried is folded once.

    State is written beside the old one under the batch's number, so a failed batch leaves the last good state.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/{number - 1}") if number else None
        fold(batch, state).write.mode("overwrite").parquet(f"{path}/{number}")

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich(df: DataFrame, static: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Stream joined to a static table, missing values filled."""
    return df.join(static, on, "left").fillna(defaults)


def score_late(df: DataFrame, ts: str, delay: str, key: Sequence[str], done: DataFrame) -> DataFrame:
    """Rows not scored yet, late ones within the delay included, each key once."""
    return dedup_stream(df, key, ts, delay).join(done.select(*key), list(key), "left_anti")
