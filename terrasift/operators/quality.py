"""Expectations: each yields rows (problem, n); none means that all hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rules:
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    #: column -> (table, column)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference isn't NULL and leads nowhere."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def _count(df: DataFrame, problem: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(problem).alias("problem"), "n")


def violations(name: str, tables: dict[str, DataFrame], rules: Rules) -> DataFrame:
    """A check holds unless it is false, so NULL passes; a key's columns must all be there. What one row shows is counted
    for all rules in one scan; keys and references need a shuffle each."""
    df = tables[name]
    alone = {f"{name}.{c} is NULL": F.col(c).isNull() for c in dict.fromkeys((*rules.key, *rules.required))}
    alone |= {f"{name}.{c}: not {rule}": ~F.expr(rule) for c, rule in rules.checks.items()}
    out = []
    if alone:
        counted = df.agg(*(F.count_if(broken).alias(f"n{i}") for i, broken in enumerate(alone.values())))
        listed = F.array(*(F.struct(F.lit(p).alias("problem"), F.col(f"n{i}").alias("n")) for i, p in enumerate(alone)))
        out.append(counted.select(F.explode(listed).alias("r")).select("r.*").where("n > 0"))
    for columns in (rules.key, *rules.unique):
        if columns:
            same = df.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))).groupBy(*columns).count().where("count > 1")
            out.append(_count(same, f"{name}({', '.join(columns)}) repeats"))
    out += [_count(orphans(df, c, tables[t], k), f"{name}.{c} not in {t}.{k}") for c, (t, k) in rules.references.items()]
    return reduce(DataFrame.unionByName, out)


def raise_all(problems: DataFrame) -> None:
    """One error that names every problem; there are as many rows as rules at most."""
    if found := problems.collect():
        raise ValueError("; ".join(f"{r['problem']} ({r['n']})" for r in found))
