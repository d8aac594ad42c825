"""A table of the last row of each key, kept by the batches of a stream as small files, and read at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    """Rows (key columns, an order column, others, and `gone`: the row deletes its key) below a path.

    A batch writes its own last rows, by buckets of the key, under its number, so a batch that runs again after a failure replaces what it had
    written. Every `compact_every` batches the deltas since the last base and that base become a new base. What is there is listed from the storage, not
    remembered: a restarted stream goes on with what an earlier one has written. A reader takes the last whole base and the whole deltas after it."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, schema: str, buckets: int = 16, compact_every: int = 8):
        self.spark, self.path, self.key, self.order, self.buckets, self.compact_every = spark, path.rstrip("/"), key, order, buckets, compact_every
        self.schema = T._parse_datatype_string(schema)
        self.columns = [f.name for f in self.schema.fields]

    def _whole(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that were written to their end."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        found = [x.getPath() for x in store.listStatus(top)]
        return sorted(int(p.getName()) for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _last(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), self.order).alias("__r")).select(*self.key, "__r.*").select(*self.columns)

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/{number}").select(*self.columns)

    def _put(self, rows: DataFrame, kind: str, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))
        rows.withColumn("__bucket", bucket).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{kind}/{number}")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Takes a micro-batch (for foreachBatch). A key's row with the greatest order counts, in whichever batch it comes."""
        self._put(self._last(batch.select(*self.columns)), "delta", number)
        if (number + 1) % self.compact_every == 0:
            self._put(self.rows(number), "base", number)

    def rows(self, upto: int | None = None) -> DataFrame:
        """The last row of each key, deleted ones included, after batch `upto` (None: the last whole one)."""
        within = lambda numbers: [n for n in numbers if upto is None or n <= upto]
        deltas, bases = within(self._whole("delta")), [n for n in within(self._whole("base")) if n != upto]
        after = bases[-1] if bases else -1
        found = self._read("base", bases[-1]) if bases else self.spark.createDataFrame([], self.schema)
        for n in deltas:
            if n > after:
                found = found.unionByName(self._read("delta", n))
        return self._last(found)

    def table(self) -> DataFrame:
        """The rows that are there."""
        return self.rows().where(~F.coalesce("gone", F.lit(False))).drop("gone")

    def of(self, **values) -> DataFrame:
        """The rows that are there with given values of other columns, such as a secondary key: judged by each key's last row, not by an earlier one."""
        found = self.table()
        for name, value in values.items():
            found = found.where(F.col(name) == value)
        return found


def kept_by(stream: DataFrame, registry: Registry) -> None:
    """Runs a stream to the end of its input into a registry; called again with the same path it goes on after the last batch."""
    query = stream.select(*registry.columns).writeStream.option("checkpointLocation", f"{registry.path}/state").trigger(availableNow=True)
    query.foreachBatch(registry.upsert).start().awaitTermination()
