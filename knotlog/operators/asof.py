"""As-of joins: for each row the last one of another table that is not newer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: Column, width: float, right_at: str | None = None, tie: str | None = None, name: str = "as_of") -> DataFrame:
    """``left`` with a struct ``name``: ``value`` of the last row of ``right`` with its keys at or before its time, or null.

    Of rows of ``right`` at one time the one with the highest ``tie`` counts.
    Times are numbers.  They are cut into buckets ``width`` wide; within a bucket
    of a key rows are ordered, and what earlier buckets hold is one row each,
    carried forward from bucket to bucket.  So a key with a third of all rows is
    as many tasks as it has buckets, and what is in order for the whole key is
    one row a bucket.  Rows whose key or time is null match nothing.
    """
    right_at = right_at or at
    order = F.struct(F.col(right_at).alias("at"), (F.col(tie) if tie else F.lit(0)).alias("tie"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = left.where(known & F.col(at).isNotNull())
    lefts = own.select(*keys, bucket(at).alias("_bucket"), F.struct(F.col(at).alias("at"), F.lit(None).cast(right.select(order.alias("o")).schema["o"].dataType["tie"].dataType).alias("tie")).alias("_order"), F.struct(*left.columns).alias("_row"))
    rights = right.where(known & F.col(right_at).isNotNull()).select(*keys, bucket(right_at).alias("_bucket"), order.alias("_order"), F.struct(value.alias("value")).alias("_value"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    # at one time rows of the right come first, the highest tie last of them
    within = Window.partitionBy(*keys, "_bucket").orderBy("_order.at", F.col("_row").isNotNull(), "_order.tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(within)).where("_row IS NOT NULL").drop("_value", "_order")
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_order"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*keys, "_bucket", "_carried")
    out = seen.join(carried, [*keys, "_bucket"]).select("_row.*", F.coalesce("_seen", "_carried")["value"].alias(name))
    rest = left.where(~(known & F.col(at).isNotNull()))
    return out.unionByName(rest, allowMissingColumns=True)
