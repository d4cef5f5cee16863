"""Relational operators: completeness, duplicates, ids, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completeness(df: DataFrame, stage: str, columns: Sequence[str] | None = None) -> DataFrame:
    """stage, column, non_null, total, pct_complete (one decimal, halves to even): one pass, then one row per column."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count("*").alias("__total"), *(F.count(F.col(f"`{c}`")).alias(c) for c in columns))
    long = counted.unpivot("__total", columns, "column", "non_null")
    share = F.when(F.col("__total") > 0, F.rint(F.col("non_null") * 1000 / F.col("__total")) / 10)
    return long.select(F.lit(stage).alias("stage"), "column", "non_null", F.col("__total").alias("total"), share.alias("pct_complete"))


def filled(columns: Sequence[str]) -> Column:
    """How many of a row's columns aren't NULL."""
    return sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))


def distinct_rows(df: DataFrame, order: str) -> DataFrame:
    """Rows that agree in all columns but the order's once: the first. NULL equals NULL."""
    keys = [c for c in df.columns if c != order]
    return df.groupBy(*keys).agg(F.min(order).alias(order)).select(df.columns)


def merge_duplicates(df: DataFrame, key: Sequence[str], name: str, order: str) -> DataFrame:
    """Rows that agree on key (NULL equals NULL) as one, if they have one name at most between them.

    The fullest row, the first of several, stays, and its gaps are filled from the next fullest that has a value. Groups
    with two different names keep all their rows.
    """
    others = [c for c in df.columns if c not in key and c != order]
    ranked = df.withColumn("__filled", filled([c for c in df.columns if c != order]))
    group = Window.partitionBy(*key)
    best = group.orderBy(F.col("__filled").desc(), F.col(order))
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # NULL if there is no name at all: then the rows may merge too.
    marked = ranked.withColumns({"__one": F.coalesce(F.min(name).over(group) == F.max(name).over(group), F.lit(True)), "__rank": F.row_number().over(best)})
    mergeable = F.col("__one")
    backfilled = marked.withColumns({f"__f_{c}": F.first(c, ignorenulls=True).over(whole) for c in others})
    kept = backfilled.where(~mergeable | (F.col("__rank") == 1))
    return kept.select(*(F.when(mergeable, F.col(f"__f_{c}")).otherwise(F.col(c)).alias(c) if c in others else F.col(c) for c in df.columns))


def first_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group; the plan keeps only that many per task before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """df persisted until release(): for rows that must be the same, or not be worked out again, in several uses."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[-1]


def release() -> None:
    """Give back what was held, once the results that read it are written."""
    while _HELD:
        _HELD.pop().unpersist()


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """1 to N in an order, without one task that sees all rows: sorted by range, then each range starts after the rows
    of those before it. The ranges' counts, one row per partition, are what is broadcast. The sorted rows are held, so that
    both uses see the same ranges; release() lets them go."""
    ordered = hold(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start") + 1
    return numbered.withColumn(name, row).drop("__at", "__part", "__start")


def number_groups(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """1 to the number of groups, in the order of their keys."""
    groups = number_rows(df.select(*key).distinct(), [F.col(k).asc_nulls_first() for k in key], name)
    groups = groups.withColumnsRenamed({k: f"__{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(groups, same).drop(*(f"__{k}" for k in key))


def lookup(df: DataFrame, column: str, id_name: str, value_name: str) -> DataFrame:
    """Ids 1 to N of a column's distinct values in their order; NULL has none."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias(value_name)).distinct()
    return number_rows(values, [value_name], id_name).select(id_name, value_name)


def split_rows(df: DataFrame, column: str, separator: str = ", ") -> DataFrame:
    """A row for each part of a joined list; rows with NULL have none."""
    return df.where(F.col(column).isNotNull()).withColumn(column, F.explode(F.split(column, separator)))


def left_join_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails if a key repeats on either side."""
    for side, what in ((left, "left"), (right, "right")):
        if not side.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats on the {what} side")
    return left.join(right, key, "left")


def ratio(part: Column, whole: Column) -> Column:
    """NULL, not an error, for an empty whole."""
    return F.try_divide(part, whole)
