"""Reviewed corrections: guarded by the value they expect, applied once, logged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions.scalars import NULL_TOKEN, number

# What a correction row holds, and the evidence it may cite.
COLUMNS = ("table", "primary_key", "column", "old_value", "new_value", "reason", "evidence_type", "evidence_source")
EVIDENCE = ("official", "internal")


def rule_violations(corrections: DataFrame) -> DataFrame:
    """Corrections that break a rule of the file itself."""
    missing = [c for c in COLUMNS if c not in corrections.columns]
    if missing:
        raise ValueError(f"corrections lack columns {missing}")
    problem = F.when(F.trim(F.coalesce("evidence_source", F.lit(""))) == "", "no evidence source").when(
        ~F.coalesce(F.col("evidence_type").isin(*EVIDENCE), F.lit(False)), "unknown evidence type")
    return corrections.withColumn("problem", problem).where("problem IS NOT NULL")


def _same(a: Column, b: Column) -> Column:
    """Equal as numbers if both are, else byte for byte."""
    return F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).otherwise(a == b)


def matched(df: DataFrame, corrections: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Each correction of the table with the row count it hits and the value found there."""
    own = corrections.where(F.col("table") == table).withColumn(
        "_parts", F.transform(F.split("primary_key", r"\|"), lambda part: F.trim(part)))
    keyed = own.select("*", *[F.try_element_at("_parts", F.lit(i + 1)).alias(f"_k{i}") for i in range(len(keys))])
    cells = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])
    rows = df.select(*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)], cells.alias("_cells"))
    names = [f"_k{i}" for i in range(len(keys))]
    # Only rows some correction names are kept, so this is small however large the table.
    hit = rows.join(keyed.select(*names).distinct(), names, "left_semi").groupBy(*names).agg(
        F.count("*").alias("hits"), F.any_value("_cells").alias("_cells"))
    return keyed.join(hit, names, "left").select(
        *own.columns[:-1], F.size("_parts").alias("_arity"), F.coalesce("hits", F.lit(0)).alias("hits"),
        F.map_contains_key("_cells", F.col("column")).alias("_known"),
        F.coalesce(F.try_element_at("_cells", F.col("column")), F.lit("")).alias("found"), *names)


def _emptied(value: Column) -> Column:
    """What a new value sets; null where it empties the cell."""
    return F.when(~F.trim(value).isin("", NULL_TOKEN), value)


def _uncastable(df: DataFrame) -> Column:
    """True where the new value is no value of its column's type."""
    wrong = F.lit(False)
    for name, kind in df.dtypes:
        wrong = F.when(F.col("column") == name, F.col("new_value").try_cast(kind).isNull()).otherwise(wrong)
    return _emptied(F.col("new_value")).isNotNull() & wrong


def violations(df: DataFrame, corrections: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Corrections that must be refused: wrong key shape, not exactly one row, unknown
    column, a value that is not the expected one (an empty or `*` expectation accepts any), or a
    new value that the column's type can't hold."""
    m = matched(df, corrections, table, keys)
    open_guard = F.col("old_value").isin("", "*")
    problem = (
        F.when(F.col("_arity") != len(keys), "key has the wrong number of parts")
        .when(F.col("hits") != 1, "did not match exactly one row")
        .when(~F.coalesce("_known", F.lit(False)), "unknown column")
        .when(~open_guard & ~_same(F.col("found"), F.col("old_value")), "old value differs")
        .when(_uncastable(df), "new value does not fit the column")
    )
    return m.withColumn("problem", problem).where("problem IS NOT NULL").select(*COLUMNS, "hits", "found", "problem")


def apply(df: DataFrame, corrections: DataFrame, table: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The corrected table and the audit log; refuses if any correction is stale.

    All changes of a row are applied together against its original key."""
    for check in (rule_violations(corrections.where(F.col("table") == table)), violations(df, corrections, table, keys)):
        bad = check.limit(5).collect()
        if bad:
            raise ValueError(f"refusing corrections for {table}: {[(r['primary_key'], r['column'], r['problem']) for r in bad]}")
    log = matched(df, corrections, table, keys)
    names = [f"_k{i}" for i in range(len(keys))]
    new = _emptied(F.col("new_value"))
    changes = log.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("column", new))).alias("_new"))
    tagged = df.select("*", *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)])
    joined = tagged.join(changes, names, "left")
    types = dict(df.dtypes)
    corrected = joined.select(*[
        F.when(F.coalesce(F.map_contains_key("_new", F.lit(c)), F.lit(False)),
               F.try_element_at("_new", F.lit(c)).try_cast(types[c])).otherwise(F.col(c)).alias(c)
        for c in df.columns
    ])
    return corrected, log.select("table", "primary_key", "column", F.col("found").alias("old"),
                                 F.col("new_value").alias("new"), "reason", "evidence_type", "evidence_source")


def from_cells(cells: DataFrame, table: str, keys: Sequence[str], rules: Sequence[tuple[str, Column, str, str, str]]) -> DataFrame:
    """Corrections generated from conflicting cells by rules, each (column, condition,
    reason, evidence type, evidence source): the right side's value is taken."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    verdict = None
    for column, condition, reason, kind, source in rules:
        test, row = (F.col("column") == column) & condition, F.struct(
            F.lit(reason).alias("reason"), F.lit(kind).alias("evidence_type"), F.lit(source).alias("evidence_source"))
        verdict = F.when(test, row) if verdict is None else verdict.when(test, row)
    return cells.withColumn("_v", verdict).where("_v IS NOT NULL").select(
        F.lit(table).alias("table"), key.alias("primary_key"), "column", F.coalesce("left", F.lit("")).alias("old_value"),
        F.coalesce("right", F.lit("")).alias("new_value"), "_v.reason", "_v.evidence_type", "_v.evidence_source")
