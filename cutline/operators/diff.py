"""Keyed comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions.scalars import number
from cutline.session import stored


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full join on the keys; each side's columns as text in a struct, null where the side has no row."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(name))

    return side(left, "l").join(side(right, "r"), list(keys), "full")



def _both(column: str) -> tuple[Column, Column]:
    return F.col("l")[column], F.col("r")[column]


def _text_differs(column: str) -> Column:
    a, b = _both(column)
    return ~F.trim(a).eqNullSafe(F.trim(b))


def _number_differs(column: str) -> Column:
    a, b = _both(column)
    return ~number(a).eqNullSafe(number(b))


def _not_number(column: str) -> Column:
    return reduce(lambda x, y: x | y, [v.isNotNull() & number(v).isNull() for v in _both(column)])


def _matched() -> Column:
    return F.col("l").isNotNull() & F.col("r").isNotNull()


def diff_summary(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: rows on one side only, rows matched, conflicting cells and their share.

    A column is compared as numbers if every value of both sides is one, else as
    trimmed text; null equals null. Everything is one aggregate over the join, so
    cells are never unrolled to rows."""
    both = aligned(left, right, keys, columns)
    hit = _matched()

    def count_if(test: Column) -> Column:
        return F.count(F.when(test, 1))

    counts = both.agg(
        count_if(F.col("r").isNull()).alias("only_left"), count_if(F.col("l").isNull()).alias("only_right"),
        count_if(hit).alias("matched"),
        F.array(*[
            F.struct(F.lit(c).alias("column"), count_if(hit & _not_number(c)).alias("texts"),
                     count_if(hit & _number_differs(c)).alias("numbers"), count_if(hit & _text_differs(c)).alias("words"))
            for c in columns
        ]).alias("per_column"),
    )
    return counts.select("only_left", "only_right", "matched", F.explode("per_column").alias("p")).select(
        F.col("p.column").alias("column"), "only_left", "only_right", "matched",
        F.when(F.col("p.texts") == 0, F.col("p.numbers")).otherwise(F.col("p.words")).alias("conflicts"),
        (F.col("p.texts") == 0).alias("numeric"),
    ).withColumn("share", F.col("conflicts") / F.greatest("matched", F.lit(1)))


def numeric_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> set[str]:
    """Columns whose every matched value is a number: one row per column reaches the driver."""
    return {r["column"] for r in diff_summary(left, right, keys, columns).where("numeric").collect()}


def diff_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
               numeric: set[str] | None = None) -> DataFrame:
    """One row per conflicting cell: keys, column, left and right value as text."""
    numeric = numeric_columns(left, right, keys, columns) if numeric is None else numeric
    differing = F.array_compact(F.array(*[
        F.when(_number_differs(c) if c in numeric else _text_differs(c),
               F.struct(F.lit(c).alias("column"), F.col("l")[c].alias("left"), F.col("r")[c].alias("right")))
        for c in columns
    ]))
    both = aligned(left, right, keys, columns).where(_matched())
    return both.select(*keys, F.explode(differing).alias("d")).select(*keys, "d.column", "d.left", "d.right")


def examples(cells: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The first k conflicting cells per column. The rank filter is applied before
    the shuffle as well, so a column full of conflicts sends k rows per task."""
    from pyspark.sql import Window

    order = Window.partitionBy("column").orderBy(*keys)
    return cells.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def one_sided(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, both directions."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def tolerance_band(a: Column, b: Column, tolerance: float) -> Column:
    """How two measurements agree; a missing one is its own band."""
    gap = F.abs(a - b)
    return F.when(a.isNull() & b.isNull(), "both_missing").when(a.isNull() | b.isNull(), "one_missing").when(
        gap == 0, "exact").when(gap <= tolerance, "within").otherwise("over")


def tolerance_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    both = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")).join(
        right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r")), list(keys), "full")
    side = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right")
    return both.withColumn("band", F.coalesce(side, tolerance_band(F.col("_a"), F.col("_b"), tolerance)))


def worst_events(left: DataFrame, right: DataFrame, keys: Sequence[str], event: str, value: str, tolerance: float, n: int) -> DataFrame:
    """The n events whose measurements differ most: (event, compared, over, largest). More differences above the tolerance come first,
    then the larger one, then the smaller event. `event` is a column of the left side; what one side lacks is not compared."""
    gap = F.abs(F.col("_a") - F.col("_b"))
    both = left.select(*keys, F.col(event), F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), list(keys)).where(gap.isNotNull())
    per = both.groupBy(event).agg(F.count("*").alias("compared"), F.count_if(gap > tolerance).alias("over"), F.max(gap).alias("largest"))
    return per.where("over > 0").orderBy(F.desc("over"), F.desc("largest"), event).limit(n)


def convention_class(a: Column, b: Column, by_convention: Column) -> Column:
    """A difference that a known convention explains is told apart from a real one."""
    return F.when(a.eqNullSafe(b), "agree").when(F.coalesce(by_convention, F.lit(False)), "expected").otherwise("real")


def change_class(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What changed between two versions: structure, values, or nothing but format."""
    if old.columns != new.columns:
        names = sorted(set(old.columns) ^ set(new.columns))
        return old.sparkSession.createDataFrame([("structure", ",".join(names), 0)], "kind string, detail string, cells bigint")
    columns = [c for c in old.columns if c not in keys]
    totals = diff_summary(old, new, keys, columns).agg(
        F.max("only_left").alias("a"), F.max("only_right").alias("b"), F.sum("conflicts").alias("cells"))
    kind = F.when(F.col("a") + F.col("b") > 0, "structure").when(F.col("cells") > 0, "values").otherwise("format only")
    return totals.select(kind.alias("kind"), F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"),
                         "cells")


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows and an order-insensitive digest: the sum of 60-bit row digests. Numbers
    are written with six places, so an integer and its double agree."""
    def text(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        shown = F.col(c).cast("decimal(38,6)") if kind in ("double", "float") else F.col(c)
        return F.coalesce(shown.cast("string"), F.lit("\\N"))

    digest = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[text(c) for c in columns])), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(digest).cast("string").alias("digest"))


def verify_fingerprints(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Tables missing, added or changed against a recorded set of fingerprints."""
    both = recorded.select("table", F.struct("rows", "digest").alias("o")).join(
        current.select("table", F.struct("rows", "digest").alias("n")), "table", "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "added").when(
        F.col("o") != F.col("n"), "changed").otherwise("same")
    return both.select("table", state.alias("state"))


def _row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """60 bits of a row's values, as a decimal, so that sums of any number of rows are exact."""
    kinds = dict(df.dtypes)
    shown = [F.coalesce((F.col(c).cast("decimal(38,6)") if kinds[c] in ("double", "float") else F.col(c)).cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *shown)), 1, 15), 16, 10).cast("decimal(38,0)")


def digest_tree(df: DataFrame, key: str, columns: Sequence[str], low: int, width: int, levels: int, fanout: int = 16) -> DataFrame:
    """(level, node, rows, digest): sums of digests of rows, key included, over ranges of a whole-number key. Level 0 is the whole table, each node has
    `fanout` children, and a leaf is a range of `width` keys from `low` on. One pass; a node is the sum of its children. Rows without
    a key are leaf -1 and its parents."""
    leaf = F.coalesce(F.floor((F.col(key) - low) / F.lit(width)), F.lit(-1)).cast("long")
    out = level = df.groupBy(leaf.alias("node")).agg(F.count("*").alias("rows"), F.sum(_row_digest(df, [key, *[c for c in columns if c != key]])).alias("digest")).select(F.lit(levels).alias("level"), "*")
    for n in range(levels - 1, -1, -1):
        parent = F.when(F.col("node") < 0, -1).otherwise(F.floor(F.col("node") / fanout)).cast("long")
        level = level.groupBy(parent.alias("node")).agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest")).select(F.lit(n).alias("level"), "*")
        out = out.unionByName(level)
    return out


def differing_leaves(old: DataFrame, new: DataFrame, levels: int, fanout: int = 16) -> DataFrame:
    """(node): leaves of two trees that differ, found from the root down: only children of nodes that differ are compared."""
    def at(tree: DataFrame, n: int, side: str) -> DataFrame:
        return tree.where(F.col("level") == n).select("node", F.struct("rows", "digest").alias(side))

    found = None
    for n in range(levels + 1):
        both = at(old, n, "a").join(at(new, n, "b"), "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if found is not None:
            above = F.when(F.col("node") < 0, -1).otherwise(F.floor(F.col("node") / fanout)).cast("long")
            both = both.withColumn("_above", above).join(found.withColumnRenamed("node", "_above"), "_above", "left_semi").select("node")
        found = both
    return found


_RANGES = 64  # ranges that are written out as a filter, which file formats can skip by; more are joined


def changed_keys(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], levels: int = 3, fanout: int = 16) -> DataFrame:
    """(key, state): keys that were `added`, are `missing` or have other values (`changed`) in the new version of a table. Both
    versions are summed up once as trees of digests over key ranges; then only the ranges that differ are read again and compared row
    by row. A key of several rows is compared as a whole; rows without a key are one."""
    ends = [df.agg(F.min(key).cast("long").alias("a"), F.max(key).cast("long").alias("b")).first() for df in (old, new)]
    known = [e for e in ends if e.a is not None]
    low, high = (min(e.a for e in known), max(e.b for e in known)) if known else (0, 0)
    width = max(1, -(-(high - low + 1) // fanout**levels))
    trees = [stored(digest_tree(df, key, columns, low, width, levels, fanout), "digest-tree") for df in (old, new)]
    leaves = stored(differing_leaves(*trees, levels, fanout), "differing-leaves")
    some = sorted(r.node for r in leaves.limit(_RANGES + 1).collect())

    def near(df: DataFrame) -> DataFrame:
        if len(some) > _RANGES:
            node = F.coalesce(F.floor((F.col(key) - low) / F.lit(width)), F.lit(-1)).cast("long")
            return df.withColumn("_node", node).join(leaves, F.col("_node") == F.col("node"), "left_semi").drop("_node")
        inside = F.lit(False)
        for n in some:
            inside = inside | (F.col(key).isNull() if n < 0 else F.col(key).between(low + n * width, low + (n + 1) * width - 1))
        return df.where(inside)

    def whole(df: DataFrame, side: str) -> DataFrame:
        return near(df).groupBy(F.col(key).alias(f"_{side}")).agg(F.struct(F.count("*").alias("rows"), F.sum(_row_digest(df, columns)).alias("digest")).alias(side))

    both = whole(old, "old").join(whole(new, "new"), F.col("_old").eqNullSafe(F.col("_new")), "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "changed")
    return both.select(F.coalesce("_old", "_new").alias(key), state.alias("state")).where("state IS NOT NULL")


def attribute_conflicts(known: DataFrame, seen: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, known, seen): attributes of matched entities that two sources state differently, compared as text. What a
    source leaves out is no conflict."""
    def cells(df: DataFrame, value: str) -> DataFrame:
        text = df.where(F.col(key).isNotNull()).select(key, *[F.col(c).cast("string").alias(c) for c in columns])
        return text.unpivot([key], list(columns), "column", value).where(F.col(value).isNotNull())

    return cells(known, "known").join(cells(seen, "seen"), [key, "column"]).where("known <> seen")


def value_status(known: DataFrame, seen: DataFrame, key: str, value: str) -> DataFrame:
    """(key, seen, known, status): each value of the second source as `same`, `conflict` or `new` to the first."""
    held = known.where(F.col(key).isNotNull()).select(key, F.col(value).alias("known"), F.lit(True).alias("_held"))
    status = F.when(F.col("_held").isNull(), "new").when(F.col("seen").eqNullSafe(F.col("known")), "same").otherwise("conflict")
    return seen.where(F.col(key).isNotNull()).select(key, F.col(value).alias("seen")).join(held, key, "left").select(
        key, "seen", "known", status.alias("status"))
