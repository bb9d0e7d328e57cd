"""Order-dependent steps that stay balanced when one key holds a large share of the rows.

A plain ``lag`` or running ``sum`` sorts a whole key in one task. Here each key is cut
into order-preserving buckets: the window runs inside (key, bucket), and only one summary
row per bucket is windowed over the whole key to carry the state across bucket borders.
``bucket`` must grow with the order columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BUCKET = "__bucket"
PLACE = "__place"


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Catalyst turns the filter into a per-task group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order."""
    return topk(df, keys, order, 1, "__first").drop("__first")


def placed(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Rows dealt once by (key, bucket), named by the column PLACE; steps with the same place, as long as the column stays, do not deal them again."""
    names = [F.col(f"{PLACE}.{c}").alias(c) if c in keys else F.col(c) for c in df.columns]  # keys travel inside PLACE alone
    return with_place(df, keys, bucket).repartition(PLACE).select(*names, PLACE)


def with_place(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """PLACE is never null, so null keys match like any other and windows and joins agree on where rows are."""
    return df if PLACE in df.columns else df.withColumn(PLACE, F.struct(*keys, bucket.alias(BUCKET)))


def over_buckets(keys: Sequence[str]):
    """Window over the one row that each bucket of a key has."""
    return Window.partitionBy(*[f"{PLACE}.{k}" for k in keys]).orderBy(f"{PLACE}.{BUCKET}")


def _within(order: Sequence[str]):
    return Window.partitionBy(PLACE).orderBy(*order)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Mapping[str, Column],
    include_current: bool = True,
) -> DataFrame:
    """Add, per output name, the last non-null value at (or strictly before) each row."""
    d = with_place(df, keys, bucket)
    for name, expr in values.items():
        d = d.withColumn(f"__v_{name}", expr)
    at = F.struct(*order)
    tails = d.groupBy(PLACE).agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__t_{n}") for n in values]
    )
    before = over_buckets(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        PLACE, *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values]
    )
    rows = _within(order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    out = d.join(carried, PLACE)
    for n in values:
        out = out.withColumn(n, F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(rows), F.col(f"__c_{n}")))
    return out.select(*df.columns, *values)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Running sum up to and including each row."""
    d = with_place(df, keys, bucket).withColumn("__x", value)
    sums = d.groupBy(PLACE).agg(F.sum("__x").alias("__s"))
    before = over_buckets(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(PLACE, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    rows = _within(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.join(offsets, PLACE)
        .withColumn(out, F.coalesce(F.sum("__x").over(rows), F.lit(0)) + F.col("__o"))
        .select(*df.columns, out)
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Mapping[str, Column],
    step: int = -1,
) -> DataFrame:
    """Values of the previous (step -1) or next (step 1) row of the same key, null at the end."""
    d = with_place(df, keys, bucket).withColumn("__v", F.struct(*[e.alias(n) for n, e in values.items()]))
    at = F.struct(*order)
    edge = (F.max_by if step < 0 else F.min_by)("__v", at).alias("__e")
    shift = F.lag if step < 0 else F.lead
    edges = d.groupBy(PLACE).agg(edge)
    carried = edges.select(PLACE, shift("__e").over(over_buckets(keys)).alias("__c"))
    near = F.coalesce(shift("__v").over(_within(order)), F.col("__c"))
    out = d.join(carried, PLACE).withColumn("__n", near)
    return out.select(*df.columns, *[F.col(f"__n.{n}").alias(n) for n in values])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """1-based position per key."""
    return running_sum(df, keys, order, bucket, F.lit(1), out)


def global_positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position of every row in the order of the whole table.

    Rows are range partitioned and sorted once; the checkpoint fixes that placement, so the partition sizes and
    the positions inside the partitions belong together whatever is recomputed later.
    """
    low_bits = (1 << 33) - 1  # monotonically_increasing_id: partition above, row number below
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ).withColumn("__p", F.shiftright("__m", 33))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return placed.join(offsets, "__p").withColumn(out, F.col("__o") + F.col("__m").bitwiseAND(low_bits) + 1).drop("__m", "__p", "__o")
