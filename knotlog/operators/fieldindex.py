"""Secondary indexes: a table's keys, and the files that hold them, by the value of one field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.sources.scratch import written

#: Buckets of a small index, keys of a bucket (about), and keys that a lookup broadcasts at most.
BUCKETS, BUCKET_ROWS, BROADCAST_ROWS = 8, 5_000_000, 500_000


def entries(rows: DataFrame, field: str, key: str = "id", *more: Column) -> DataFrame:
    """``value, key`` of every value of a field, once each, as text; an array counts for each of its items."""
    many = dict(rows.dtypes)[field].startswith("array")
    value = F.explode(F.col(f"`{field}`")) if many else F.col(f"`{field}`")
    each = rows.select(value.alias("value"), F.col(f"`{key}`").alias("key"), *more)
    return each.withColumn("value", F.col("value").cast("string")).where("value IS NOT NULL AND key IS NOT NULL").distinct()


def evaluated(spark: SparkSession, values: list[str], make) -> list:
    """``make(column)`` for each of some texts, computed where the plan is made: no job runs."""
    if not values:
        return []
    rows = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({i}, :v{i})' for i in range(len(values)))} AS t(i, value)", args={f"v{i}": v for i, v in enumerate(values)})
    return [r["x"] for r in sorted(rows.select("i", make(F.col("value")).alias("x")).collect(), key=lambda r: r["i"])]


@dataclass
class FieldIndex:
    """A stored index of one field, in parts that were written one after the other.

    A part has ``bucket`` as folders and ``value, key`` (and what else its
    entries have) sorted by value, so a lookup reads one bucket's files and of
    them what can hold its values.
    """

    spark: SparkSession
    parts: list[str]
    buckets: int

    @classmethod
    def build(cls, rows: DataFrame, field: str, path: str, key: str = "id") -> FieldIndex:
        """Back-fills an index of ``field``; rows without a value have no entry."""
        each = written(entries(rows, field, key), "entries")
        index = cls(rows.sparkSession, [path], buckets_for(each.count()))
        index.write(each, path)
        return index

    def write(self, each: DataFrame, path: str) -> None:
        """Entries as a part.

        They are dealt by ranges of bucket, value and key, so a value that a
        third of all rows have is many tasks and files.
        """
        rows = each.withColumn("bucket", self._bucket(F.col("value")))
        rows.repartitionByRange(self.buckets, "bucket", "value", "key").sortWithinPartitions("bucket", "value", "key").write.partitionBy("bucket").parquet(path)

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def lookup(self, values: list[str]) -> DataFrame:
        """Entries of some values; ``value, key`` and what else there is."""
        numbers = sorted(set(evaluated(self.spark, values, self._bucket)))
        out = None
        for path in self.parts:  # parts may have other columns
            part = self.spark.read.parquet(path).where(F.col("bucket").isin(numbers) & F.col("value").isin(values)).drop("bucket")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def keys(self, values: list[str]) -> DataFrame:
        """``key`` of the rows that have one of the values."""
        return self.lookup(values).select("key").distinct()

    def rows(self, table: DataFrame, values: list[str], key: str = "id") -> DataFrame:
        """The table's rows that have one of the values."""
        found = self.keys(values).withColumnRenamed("key", key)
        return table.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, key, "left_semi")


def buckets_for(count: int) -> int:
    """How many buckets an index of so many entries has."""
    return max(BUCKETS, -(-count // BUCKET_ROWS))


def backfill_index(store, table: str, field: str, key: str = "id") -> bool:
    """Makes a store's index of a field, once; whether it was made now."""
    if field in store.indexes(table):
        return False
    store.add_index(table, field, key=key)
    return True
