"""Gapless ordinals without a global window, and an index of pages that a stopped run takes up where it was left.

Rows are dealt out by ranges of their order, numbered inside each range, and each range starts where the ones before it
end: one exchange, one sort of each range, and a window over a row a range. The order must tell rows apart (add an
id), so a value that a third of all rows share is split over ranges like any other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import written


def _dealt(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """df by ranges of its order: so many, or as many as the session's shuffles have (AQE joins small neighbours)."""
    return df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)


def ordinals(df: DataFrame, order: list[Column], name: str = "ordinal", start: int = 0, ranges: int | None = None) -> DataFrame:
    """df with a running number in the given order, from `start`, without gaps. Rows equal in the order come in any one."""
    dealt = _dealt(df, order, ranges).sortWithinPartitions(*order)
    # a row's number inside its task is in the low 33 bits, in the order that the sort gave
    numbered = dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    numbered = written(numbered, "ordinals")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = numbered.join(F.broadcast(starts), "_range")  # a row a range
    return out.withColumn(name, F.col("_start") + F.col("_at") + F.lit(start)).drop("_range", "_at", "_start")


def running(df: DataFrame, order: list[Column], columns: dict[str, str], ranges: int | None = None) -> DataFrame:
    """df with running sums in the given order: columns names each sum and the column that it is of. Like ordinals, each
    range adds its own sums to those of the ranges before it."""
    dealt = written(_dealt(df, order, ranges).withColumn("_range", F.spark_partition_id()), "running")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in columns.items()))
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in columns))
    out = dealt.join(F.broadcast(starts), "_range")
    return out.withColumns({k: F.sum(c).over(inside) + F.col(f"_{k}") for k, c in columns.items()}).drop("_range", *(f"_{k}" for k in columns))


class PageIndex:
    """An index (ordinal and the columns of its rows) that grows batch by batch in a shared folder.

    The plan, the bounds that cut the order into batches, is stored before the first batch, with a fingerprint of
    the source. A batch is one file set `batch=N` and, written after it, a note with the next ordinal. A run that stops
    anywhere leaves whole batches with notes and at most one without, which the next run writes anew; the index
    comes out the same. A source that isn't the one of the plan is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _has(self, name: str) -> bool:
        fs, p = self._file(name)
        return fs.exists(p)

    def _note(self, name: str, value: dict) -> None:
        """Written under another name first, so that a note is whole or isn't there."""
        self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.new")
        fs, p = self._file(name)
        fs.rename(self._file(f"{name}.new")[1], p)

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])

    @staticmethod
    def fingerprint(df: DataFrame) -> str:
        """Rows and a sum of hashes, which don't depend on the order of rows."""
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        return f"{row.n}:{row.h}"

    def next_ordinal(self) -> int:
        done = self.batches_done()
        return self._read(f"note-{done - 1}")["next_ordinal"] if done else 0

    def batches_done(self) -> int:
        n = 0
        while self._has(f"note-{n}"):
            n += 1
        return n

    def build(self, df: DataFrame, key: str, batches: int, stop_after: int | None = None) -> bool:
        """Index df in the order of `key` (a numeric column that tells rows apart) in so many batches; True once all are
        there. stop_after ends this run after so many batches, as a loss of the driver would."""
        print_ = self.fingerprint(df)
        if not self._has("plan"):
            cuts = sorted(set(df.approxQuantile(key, [i / batches for i in range(1, batches)], 0.001))) if batches > 1 else []
            self._note("plan", {"source": print_, "key": key, "cuts": cuts})
        plan = self._read("plan")
        if plan["source"] != print_ or plan["key"] != key:
            raise ValueError("the source isn't the one that this index was begun with")
        bounds = [None, *plan["cuts"], None]
        made = 0
        for no in range(self.batches_done(), len(bounds) - 1):
            if stop_after is not None and made == stop_after:
                return False
            low, high = bounds[no], bounds[no + 1]
            rows = df.filter(F.col(key) >= low) if low is not None else df
            rows = rows.filter(F.col(key) < high) if high is not None else rows
            start = self.next_ordinal()
            ordinals(rows, [F.col(key)], start=start).write.mode("overwrite").parquet(f"{self.path}/batch={no}")
            n = self.spark.read.parquet(f"{self.path}/batch={no}").count()
            self._note(f"note-{no}", {"next_ordinal": start + n})
            made += 1
        return True

    def page(self, ordinal: int, size: int) -> DataFrame:
        """The rows from an ordinal on; a batch whose statistics exclude them isn't read."""
        done = [f"{self.path}/batch={i}" for i in range(self.batches_done())]
        rows = self.spark.read.parquet(*done)
        return rows.filter((F.col("ordinal") >= ordinal) & (F.col("ordinal") < ordinal + size))

    def rows(self) -> DataFrame:
        return self.page(0, 1 << 62)
