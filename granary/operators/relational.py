"""Joins, aggregates and paging that need more than one DataFrame call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """Each parent with its number of children; 0 without any. Children are counted by key before they meet the parents."""
    counted = children.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def within_an_hour(early: DataFrame, late: DataFrame, key: str, at: str) -> DataFrame:
    """Pairs (aliases `early` and `late`) of rows with the same key of which the late one is at most an hour younger.

    Both meet by key and hour: an early row stands in its own hour and in the next, so no key gathers all of its rows.
    """
    hours = F.explode(F.array(F.date_trunc("hour", at), F.date_trunc("hour", F.expr(f"{at} + INTERVAL 1 HOUR"))))
    a, b = early.withColumn("_hour", hours).alias("early"), late.withColumn("_hour", F.date_trunc("hour", at)).alias("late")
    on = F.expr(f"early.{key} = late.{key} AND early._hour = late._hour AND early.{at} <= late.{at} AND late.{at} - early.{at} <= INTERVAL 1 HOUR")
    return a.join(b, on)


def nested(parents: DataFrame, children: DataFrame, key: str, foreign: str, child: str, name: str) -> DataFrame:
    """Each parent with the sorted array of a column of its children; empty without any.

    Children are gathered by key before they meet the parents, so that only their keys and one column move.
    """
    held = children.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(child)).alias(name))
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array()))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order that should be unique; planned as one TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def page_after(df: DataFrame, key: str, last: int, n: int) -> DataFrame:
    """The n rows after a key: a filter that reaches the scan, unlike an offset."""
    return df.filter(F.col(key) > last).orderBy(key).limit(n)


def moving_average(df: DataFrame, group: str, order: list[str], value: str, width: int) -> DataFrame:
    """Mean of each group's last `width` values in the given order; a null counts as 0."""
    last = Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))
    held = df.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= width)
    return held.groupBy(group).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("moving_average"))


def unite(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts."""
    return reduce(DataFrame.unionByName, parts)


def not_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN: no row at all if the other side has a null, and no row with a null unless the other side is empty.

    The two facts about the other side are one aggregate row; the rest is an ordinary anti join, which can shuffle.
    """
    facts = other.agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col(key).isNull(), 1)).alias("_nulls"))
    held = df.join(other.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti").crossJoin(F.broadcast(facts))
    return held.filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_rows", "_nulls")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """An inner join on one key whose hot values are dealt to `salts` tasks; the small side is repeated as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")
