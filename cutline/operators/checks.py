"""Declarative checks: each is a query for violations, reported as PASS, FAIL or SKIP."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Check:
    """`violations` has a row per violation; None means the check cannot apply, because of `why`."""

    group: str
    name: str
    violations: DataFrame | None
    why: str = ""


@dataclass(frozen=True)
class RowCheck:
    """Rows of a table for which `broken` holds. With `keys`, `broken` is a condition on aggregates of each group, and groups count."""

    group: str
    name: str
    table: DataFrame
    broken: Column
    keys: tuple[str, ...] = ()


def _reported(group: Column, name: Column, violations: Column) -> list[Column]:
    return [group.alias("group"), name.alias("name"), F.when(violations == 0, "PASS").otherwise("FAIL").alias("status"), violations.alias("violations"), F.lit("").alias("detail")]


def fused(checks: Sequence[RowCheck]) -> DataFrame:
    """Checks of one table with the same keys, in one visit of it: a row per check. An unknown condition is no violation."""
    table, keys = checks[0].table, checks[0].keys
    broken = [F.coalesce(c.broken, F.lit(False)).alias(f"_b{i}") for i, c in enumerate(checks)]
    rows = table.groupBy(*keys).agg(*broken) if keys else table.select(*broken)
    counted = rows.agg(*[F.count_if(f"_b{i}").alias(f"_n{i}") for i in range(len(checks))])
    listed = F.explode(F.array(*[F.struct(F.lit(c.group).alias("g"), F.lit(c.name).alias("n"), F.col(f"_n{i}").alias("v")) for i, c in enumerate(checks)])).alias("c")
    return counted.select(listed).select(*_reported(F.col("c.g"), F.col("c.n"), F.col("c.v")))


def run_checks(spark: SparkSession, checks: Sequence[Check | RowCheck]) -> DataFrame:
    """One row per check. A check that cannot apply is listed as skipped, never left out. All row checks of a table, and all group
    checks of a table with the same keys, share one visit of it."""
    rows, together = [], {}
    for c in checks:
        if isinstance(c, RowCheck):
            together.setdefault((id(c.table), c.keys), []).append(c)
        elif c.violations is None:
            rows.append(spark.range(1).select(F.lit(c.group).alias("group"), F.lit(c.name).alias("name"),
                                              F.lit("SKIP").alias("status"), F.lit(0).cast("bigint").alias("violations"),
                                              F.lit(c.why).alias("detail")))
        else:
            rows.append(c.violations.agg(F.count("*").alias("_n")).select(*_reported(F.lit(c.group), F.lit(c.name), F.col("_n"))))
    return reduce(DataFrame.unionByName, [*rows, *[fused(some) for some in together.values()]])


def require(report: DataFrame) -> None:
    failed = [f"{r['group']}: {r['name']} ({r['violations']})" for r in report.where("status = 'FAIL'").collect()]
    if failed:
        raise ValueError("checks failed: " + "; ".join(failed))


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent row; null refers to nothing."""
    return child.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).join(
        parent.select(F.col(parent_column).alias("value")), "value", "left_anti").distinct()


def unreferenced(parent: DataFrame, parent_column: str, children: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Parent rows no child refers to."""
    used = reduce(DataFrame.unionByName, [c.select(F.col(k).alias("value")).distinct() for c, k in children])
    return parent.select(F.col(parent_column).alias("value")).join(used, "value", "left_anti")


def not_dense(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Groups whose values are not exactly 1..N. Values are made distinct first, so
    no group's values are gathered."""
    cells = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    per = cells.groupBy(*keys).agg(F.sum("_c").alias("rows"), F.count("_v").alias("distinct_values"),
                                   F.min("_v").alias("low"), F.max("_v").alias("high"))
    return per.where(~F.coalesce((F.col("low") == 1) & (F.col("high") == F.col("rows"))
                                 & (F.col("distinct_values") == F.col("rows")), F.lit(False)))


def uncovered(expected: DataFrame, key: str, table: DataFrame, exceptions: Sequence = ()) -> DataFrame:
    """Expected keys with no row in the table, documented exceptions aside."""
    wanted = expected.select(key).distinct()
    if exceptions:
        wanted = wanted.where(~F.col(key).isin(*exceptions))
    return wanted.join(table.select(key).distinct(), key, "left_anti")


def outside(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).between(low, high))


def group_sizes_outside(df: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(~F.col("rows").between(low, high))


def flag_mismatch(df: DataFrame, flag: str, unknown: Column, reason: str, allowed: Sequence[str]) -> DataFrame:
    """A tri-state flag must be null exactly where it is unknown, carry a reason unless
    true and none if true, and the reason must be an agreed one."""
    f = F.col(flag)
    bad = (f.isNull() != unknown) | (~F.coalesce(f, F.lit(False)) & F.col(reason).isNull()) \
        | (F.coalesce(f, F.lit(False)) & F.col(reason).isNotNull()) \
        | F.coalesce(~F.col(reason).isin(*allowed), F.lit(False))
    return df.where(bad)


def multiset_mismatch(official: DataFrame, ours: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values whose number of occurrences per key differs between two lists."""
    a = official.groupBy(*keys, value).agg(F.count("*").alias("_a"))
    b = ours.groupBy(*keys, value).agg(F.count("*").alias("_b"))
    return a.join(b, [*keys, value], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
