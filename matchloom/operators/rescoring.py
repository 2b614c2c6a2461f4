"""Scores under model versions, replaced batch by batch in partitioned tables, so that a batch that dies loses nothing and leaves nothing.

Rows (events) and summaries (one a match) are tables partitioned by version and bucket, the hash of the match. A batch is a bucket: its new rows are
written, then its new summaries, each by an overwrite of that partition alone, and only then the old partitions are dropped. Any step can
be repeated. Readers take the rows whose version is their match's summary's newest one; rows that a dead batch left under an
older version than that are orphans, which the sweep removes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

BUCKETS = 16


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class ScoreStore:
    """Two tables of the session's catalog, `<name>_rows` and `<name>_summary`, partitioned by version and bucket."""

    def __init__(self, spark: SparkSession, name: str, key: str = "match_id", buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.tables = {"rows": f"{name}_rows", "summary": f"{name}_summary"}

    def table(self, kind: str) -> DataFrame:
        self.spark.catalog.refreshTable(self.tables[kind])
        return self.spark.table(self.tables[kind])

    def create(self, rows: DataFrame, summary: DataFrame) -> None:
        """rows and summary hold the key and a version; a null version, never scored, counts as 0."""
        for kind, df in (("rows", rows), ("summary", summary)):
            df = df.withColumn("version", F.coalesce("version", F.lit(0)).cast("int")).withColumn("bucket", bucket_of(self.key, self.buckets))
            df.repartition("bucket").write.partitionBy("version", "bucket").format("parquet").saveAsTable(self.tables[kind])

    def drop(self) -> None:
        for t in self.tables.values():
            self.spark.sql(f"drop table if exists {t}")

    def replace(self, kind: str, df: DataFrame, version: int, bucket: int) -> None:
        """df in place of what the partition holds; an empty df drops it."""
        df = written(df.drop("version", "bucket"), "rescored")  # what is read must not be what is overwritten
        if df.isEmpty():
            self.forget(kind, version, bucket)
            return
        self.spark.sql(f"alter table {self.tables[kind]} add if not exists partition (version = {version}, bucket = {bucket})")
        columns = [c for c in self.spark.table(self.tables[kind]).columns if c not in ("version", "bucket")]
        self.spark.sql(f"insert overwrite table {self.tables[kind]} partition (version = {version}, bucket = {bucket}) select {', '.join(columns)} from {{new}}", new=df)

    def forget(self, kind: str, version: int, bucket: int) -> None:
        self.spark.sql(f"alter table {self.tables[kind]} drop if exists partition (version = {version}, bucket = {bucket})")

    def partitions(self, kind: str) -> list[tuple[int, int]]:
        """(version, bucket) of a table: as many as versions times buckets, whatever the rows."""
        found = self.spark.sql(f"show partitions {self.tables[kind]}").collect()
        return sorted(tuple(int(x.split("=")[1]) for x in r[0].split("/")) for r in found)

    def newest(self) -> DataFrame:
        return self.table("summary").groupBy(self.key).agg(F.max("version").alias("version"))

    def current(self) -> DataFrame:
        """The rows that count: of every match those of its summary's newest version."""
        return self.table("rows").drop("bucket").join(self.newest(), [self.key, "version"], "left_semi")

    def sweep(self) -> int:
        """Removes rows of a version older than their match's summary, and older summaries; returns how many rows went.

        Rows of a newer version than the summary stay: their batch died before its summaries were written and will be repeated. Only partitions that
        hold orphans are written anew.
        """
        gone = 0
        for kind in ("rows", "summary"):
            newest = self.newest().withColumnRenamed("version", "_newest")
            old = self.table(kind).join(newest, self.key).where("version < _newest")
            for r in old.groupBy("version", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a partition
                part = self.table(kind).where((F.col("version") == r.version) & (F.col("bucket") == r.bucket))
                self.replace(kind, part.join(newest.where(F.col("_newest") > r.version), self.key, "left_anti"), r.version, r.bucket)
                gone += r.n if kind == "rows" else 0
        return gone

    def rescore(self, target: int, score: Callable[[DataFrame], DataFrame], summarise: Callable[[DataFrame], DataFrame], batches: int | None = None, fail: str | None = None) -> int:
        """Brings every match under an older version than `target` to it, a bucket a batch, and returns the number of batches done.

        score(rows) gives the same rows scored anew, without those that cannot be; such matches leave both tables. summarise(rows) gives a
        summary a match. Run again after a failure it sweeps first and goes on where it was. `fail` raises after a step, for tests.
        """
        self.sweep()
        done = 0
        pending = sorted({(v, b) for kind in ("summary", "rows") for v, b in self.partitions(kind) if v < target})
        for bucket in sorted({b for _, b in pending}):
            if batches is not None and done >= batches:
                break
            old = [v for v, b in pending if b == bucket]
            here = (F.col("bucket") == bucket) & F.col("version").isin(*old)
            # of the new version only what has its summary too; the rest is from a batch that died
            done_before = self.newest().where(F.col("version") == target).select(self.key)
            kept = lambda kind: self.table(kind).where((F.col("bucket") == bucket) & (F.col("version") == target)).join(done_before, self.key, "left_semi")
            rows = written(score(self.table("rows").where(here).join(self.newest(), [self.key, "version"], "left_semi").drop("version", "bucket")), "scored")
            mine = rows.select(self.key).distinct()
            merged = lambda kind, new: kept(kind).drop("version", "bucket").join(mine, self.key, "left_anti").unionByName(new)
            self.replace("rows", merged("rows", rows), target, bucket)
            if fail == "rows":
                raise RuntimeError("stopped after the rows")
            self.replace("summary", merged("summary", summarise(rows)), target, bucket)
            if fail == "summary":
                raise RuntimeError("stopped after the summaries")
            for v in old:
                self.forget("rows", v, bucket)
                self.forget("summary", v, bucket)
            done += 1
        return done


def rescoring_progress(store: ScoreStore) -> DataFrame:
    """(version, matches, rows) of what counts."""
    return store.current().groupBy("version").agg(F.count_distinct(store.key).alias("matches"), F.count(F.lit(1)).alias("rows"))

