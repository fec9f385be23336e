"""Ranks, previous values and running sums over groups that no task could hold.

A window partitioned by a group puts the whole group into one task. Here rows are dealt by range of group and order, so
that a large group lies in many ranges; what a range needs to know of those before it (how many rows, the last values, how
much has been summed) is one row per group and range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.storage import shared_table

#: Columns that the functions of this module keep beside the rows until ``settled``.
PLACE = ("_range", "_at")


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with their range and a number that ascends within a group in the given order.

    Rows of equal order come as they come, and are told apart for dealing only. Null groups are groups.
    """
    names = [f"_order{k}" for k in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, [c for c, _ in map(_plain, order)]))).withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, (_, down) in zip(names, map(_plain, order))]
    keys = [*[F.col(g) for g in group], *sort, F.col("_tie")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*names, "_tie")
    numbered = dealt.withColumn("_at", F.monotonically_increasing_id())
    return shared_table(numbered.withColumn("_range", F.shiftright("_at", 33)), "placed")


class Down:
    """A column in descending order, nulls last; a bare column ascends, nulls first."""

    def __init__(self, column: Column) -> None:
        self.column = column


def _plain(order: Column | Down) -> tuple[Column, bool]:
    return (order.column, True) if isinstance(order, Down) else (order, False)


def _carried(rows: DataFrame, group: Sequence[str], per_range: Sequence[Column], before: Mapping[str, Column]) -> DataFrame:
    """``rows`` with columns made of what the ranges before theirs hold of their group."""
    ranges = rows.groupBy(*group, "_range").agg(*per_range)
    told = ranges.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_range").alias("_r"), *[c.alias(n) for n, c in before.items()])
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    return rows.join(told, reduce(lambda a, b: a & b, same, F.col("_range") == F.col("_r"))).drop("_r", *[f"_g{k}" for k in range(len(group))])


def _earlier(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _within(group: Sequence[str]):
    return Window.partitionBy("_range", *group).orderBy("_at")


def numbered(rows: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Adds each placed row's number within its group, from 1."""
    out = _carried(rows, group, [F.count("*").alias("_n"), F.min("_at").alias("_first")], {"_first": F.col("_first"), "_before": F.coalesce(F.sum("_n").over(_earlier(group)), F.lit(0))})
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def with_previous(rows: DataFrame, group: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Adds under new names what columns hold on the row before, and ``_has_previous``; null on a group's first row."""
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), "_at").alias("_last")
    out = _carried(rows, group, [last], {"_known": F.last("_last").over(_earlier(group))})
    here = F.lag(F.struct(*[F.col(c).alias(n) for n, c in values.items()])).over(_within(group))
    out = out.withColumn("_previous", F.coalesce(here, F.col("_known")))
    return out.withColumns({n: F.col(f"_previous.{n}") for n in values}).withColumn("_has_previous", F.col("_previous").isNotNull()).drop("_previous", "_known")


def with_running_sum(rows: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` (a whole number) over a group's rows up to and with this one."""
    out = _carried(rows.withColumn("_value", value.cast("long")), group, [F.sum("_value").alias("_sum")], {"_before": F.coalesce(F.sum("_sum").over(_earlier(group)), F.lit(0))})
    here = F.sum("_value").over(_within(group).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn(name, here + F.col("_before")).drop("_before", "_value")


def exact_medians(values: DataFrame, group: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(group, name): the exact median of each group's values, nulls left out; the mean of the middle two of an even number.

    Values are counted first, which is summed before anything is shuffled; the counts are then added up in order of value. No task holds
    a group's values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_often"))
    upto = with_running_sum(placed(counts, group, [F.col(value)]), group, F.col("_often"), "_upto")
    total = counts.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.sum("_often").alias("_total"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    reach = lambda n: F.min(F.when(F.col("_upto") >= n, F.col(value)))
    both = upto.join(total, reduce(lambda a, b: a & b, same)).groupBy(*group)
    halves = both.agg(reach(F.expr("(_total + 1) div 2")).alias("_low"), reach(F.expr("_total div 2 + 1")).alias("_high"))
    return halves.select(*group, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def settled(rows: DataFrame) -> DataFrame:
    """The rows without what placed them."""
    return rows.drop(*PLACE, "_has_previous")


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column | Down], name: str) -> DataFrame:
    """``rows`` with their number within their group in the given order, from 1."""
    return settled(numbered(placed(rows, group, order), group, name))
