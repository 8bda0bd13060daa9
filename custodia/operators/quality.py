"""Data-quality rules: column tests and counts of violating rows, all in one pass."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class ColumnExists:
    name: str
    column: str


@dataclass(frozen=True)
class RowCount:
    """The number of rows that meet ``predicate`` compares true with ``bound``."""

    name: str
    predicate: str
    op: str = "="
    bound: int = 0


def rule_column_exists(df: DataFrame, column: str) -> bool:
    return column in df.columns


def rule_row_count(df: DataFrame, predicate: str | Column, op: str = "=", bound: int = 0) -> DataFrame:
    """One row: how many rows meet the predicate and whether that passes."""
    test = F.expr(predicate) if isinstance(predicate, str) else predicate
    counted = df.agg(F.count_if(test).alias("value"))
    return counted.withColumn("passed", COMPARE[op](F.col("value"), F.lit(bound)))


def evaluate_ruleset(df: DataFrame, rules: list[ColumnExists | RowCount]) -> DataFrame:
    """A scorecard with one row per rule: ``rule, outcome, value``.

    Counting rules share a single aggregation. A rule over a column that is not there fails.
    """
    counts = [_count(df, rule) for rule in rules]
    totals = df.agg(*[c.alias(f"rule_{i}") for i, c in enumerate(counts)])
    rows = []
    for i, rule in enumerate(rules):
        value = F.col(f"rule_{i}")
        if isinstance(rule, ColumnExists):
            passed = F.lit(rule_column_exists(df, rule.column))
        else:
            passed = F.coalesce(COMPARE[rule.op](value, F.lit(rule.bound)), F.lit(False))
        outcome = F.when(passed, "Passed").otherwise("Failed")
        rows.append(F.struct(F.lit(rule.name).alias("rule"), outcome.alias("outcome"), value.alias("value")))
    return totals.select(F.inline(F.array(*rows)))


def _count(df: DataFrame, rule: ColumnExists | RowCount) -> Column:
    nothing = F.max(F.lit(None).cast("bigint"))
    if isinstance(rule, ColumnExists):
        return nothing
    try:
        df.select(F.expr(rule.predicate))
    except AnalysisException:
        return nothing
    return F.count_if(F.expr(rule.predicate))
