"""Window operators on gap-free daily series.

An entity's window holds one row per day, so its size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockweave.session import cut_lineage


def first_sale_trim(sales: DataFrame, entities: Sequence[str], time: str = "date", value: str = "quantity") -> DataFrame:
    """Drop each series' rows before its first positive value (all rows when it never sells)."""
    first = F.min(F.when(F.col(value) > 0, F.col(time))).over(W.partitionBy(*entities))
    return sales.withColumn("_first", first).where(F.col(time) >= F.col("_first")).drop("_first")


def trailing_means(grid: DataFrame, entities: Sequence[str], windows: Sequence[int], time: str = "date", value: str = "quantity",
                   inclusive: bool = False) -> DataFrame:
    """``mean_<n>``: mean of the last n days before each day (or up to it, when ``inclusive``).

    Differences of one running sum, so the cost does not depend on n. Null without any history.
    """
    order = W.partitionBy(*entities).orderBy(time)
    upto = order.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    frame = grid.withColumns({"_sum": F.sum(value).over(upto), "_n": F.count(value).over(upto)})

    def mean(n: int) -> Column:
        before = F.coalesce(F.lag("_sum", n).over(order), F.lit(0))
        return F.when(F.col("_n") > 0, (F.col("_sum") - before) / F.least(F.col("_n"), F.lit(n)))

    return frame.withColumns({f"mean_{n}": mean(n) for n in windows}).drop("_sum", "_n")


def same_weekday_mean(grid: DataFrame, entities: Sequence[str], count: int = 4, time: str = "date", value: str = "quantity") -> DataFrame:
    """Mean of the last ``count`` values of the row's own weekday, the row included."""
    order = W.partitionBy(*entities).orderBy(time)  # the grid has every day, so the same weekday is 7 rows back
    values = [F.col(value), *[F.lag(value, 7 * k).over(order) for k in range(1, count)]]
    known = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])
    return grid.withColumn(f"mean_same_weekday_{count}", F.when(known > 0, total / known))


def last_value_before(grid: DataFrame, entities: Sequence[str], time: str = "date", value: str = "quantity") -> DataFrame:
    return grid.withColumn("last_value", F.lag(value, 1).over(W.partitionBy(*entities).orderBy(time)))


def latest_origin_per_date(forecasts: DataFrame, entities: Sequence[str], time: str = "date") -> DataFrame:
    """The rows of the latest origin <= date, one per (entity, date): the forecast in use that day."""
    eligible = forecasts.where(F.col("origin_date") <= F.col(time))
    values = [c for c in forecasts.columns if c not in (*entities, time, "origin_date")]
    newest = F.max_by(F.struct("origin_date", *values), F.col("origin_date")).alias("_row")
    return eligible.groupBy(*entities, time).agg(newest).select(*entities, time, "_row.*")


def duplicate_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and their rows beyond the first (null parts equal each other)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1).select(*key, (F.col("n") - 1).alias("extra_rows"))


def distributed_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Global 1-based position in sort order without a single-partition window.

    ``order`` must end with a unique column: range partitioning then splits runs of equal values too.
    The sorted layout is written to the checkpoint folder so that positions survive lost executors;
    the per-partition offsets are one small row per partition.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    numbered = cut_lineage(ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, position = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition
    return placed.withColumn(name, (F.col("_offset") + position + 1).cast("bigint")).drop("_id", "_part", "_offset")


def ranks_within(df: DataFrame, group: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in sort order within each value of ``group``, for any size of group, from one sort for all of them.

    As ``distributed_rank``, whose rules hold for ``order``: rows are range-partitioned by group and order, and a group that spans
    partitions gets the sizes of its earlier parts. The offsets are a row per partition and group. Rows without a group are left out.
    """
    keys = [F.col(group), *order]
    numbered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"))
    sizes = numbered.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    placed = numbered.join(offsets, [group, "_part"])
    return placed.withColumn(name, (F.col("_offset") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_offset")


def sequence_ids(df: DataFrame, order: Sequence[Column], name: str, prefix: str = "", start: int = 1, width: int = 3,
                 as_int: bool = False) -> DataFrame:
    """``<prefix><n zero-padded>`` or plain integers, numbered in key order."""
    numbered = distributed_rank(df, order, "_n")
    number = F.col("_n") + F.lit(start - 1)
    text = F.concat(F.lit(prefix), F.when(F.length(number.cast("string")) < width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string")))
    return numbered.withColumn(name, number if as_int else text).drop("_n")
