"""Signal bytes of an address range as single bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def signal_bits(ranges: DataFrame) -> DataFrame:
    """One row per bit: machine, address, value. A range whose length is wrong gives null values (unknown is not 0).

    ``ranges``: machine, area, start, end, data (BINARY or null). Works on batches and on streams.
    """
    n = F.col("end") - F.col("start") + 1
    good = F.length("data") == n
    data = F.when(good, F.col("data"))
    bytes_ = ranges.select("machine", "area", "start", data.alias("data"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    value = F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    b = bytes_.select("machine", "area", (F.col("start") + F.col("i")).alias("number"), value.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    address = F.concat("area", F.col("number").cast("string"), F.lit("."), F.col("bit").cast("string"))
    return b.select("machine", address.alias("address"), F.expr("shiftright(v, bit)").bitwiseAND(1).alias("value"))
