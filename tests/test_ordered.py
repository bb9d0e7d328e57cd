"""Bucketed order steps equal the plain windows, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from plantlens.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data, at = [], 0
    for _ in range(3000):
        at += rng.randint(1, 9)
        key = "hot" if rng.random() < 0.7 else f"k{rng.randint(0, 20)}"
        data.append((key, at, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "key string, at long, v int")


PLAIN_KEY, PLAIN_ORDER = "key", "at"


def bucket():
    return F.floor(F.col("at") / 97)


def plain():
    return Window.partitionBy(PLAIN_KEY).orderBy(PLAIN_ORDER)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("include", [True, False])
def test_carry_last(rows, include):
    got = ordered.carry_last(rows, ["key"], ["at"], bucket(), {"x": F.col("v")}, include)
    frame = plain().rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    same(got, rows.withColumn("x", F.last("v", ignorenulls=True).over(frame)))


def test_running_sum(rows):
    got = ordered.running_sum(rows, ["key"], ["at"], bucket(), F.col("v"), "x")
    same(got, rows.withColumn("x", F.coalesce(F.sum("v").over(plain().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour(rows, step):
    got = ordered.neighbour(rows, ["key"], ["at"], bucket(), {"x": F.col("v"), "y": F.col("at")}, step)
    shift = F.lag if step < 0 else F.lead
    same(got, rows.withColumn("x", shift("v").over(plain())).withColumn("y", shift("at").over(plain())))


def test_number_rows_and_positions(rows):
    got = ordered.number_rows(rows, ["key"], ["at"], bucket(), "n")
    same(got, rows.withColumn("n", F.row_number().over(plain())))
    order = [F.col("at").desc()]
    got = ordered.global_positions(rows, order, "n")
    same(got, rows.withColumn("n", F.row_number().over(Window.orderBy(*order))))


def test_topk_is_limited_before_the_shuffle(rows):
    plan = ordered.topk(rows, ["key"], [F.col("at").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rows_with_a_null_key_stay(spark):
    from pyspark.sql import functions as F

    from plantlens.operators import ordered

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 5)], "k string, n int")
    assert sorted((r.k or "", r.n, r.at) for r in ordered.number_rows(df, ["k"], ["n"], F.col("n"), "at").collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1), ("a", 5, 2)]
    near = ordered.neighbour(df, ["k"], ["n"], F.col("n"), {"p": F.col("n")}).collect()
    assert sorted((r.k or "", r.n, r.p or 0) for r in near) == [("", 1, 0), ("", 2, 1), ("a", 1, 0), ("a", 5, 1)]
    last = ordered.carry_last(df, ["k"], ["n"], F.col("n"), {"p": F.when(F.col("n") == 1, F.col("n"))}).collect()
    assert sorted((r.k or "", r.n, r.p) for r in last) == [("", 1, 1), ("", 2, 1), ("a", 1, 1), ("a", 5, 1)]
