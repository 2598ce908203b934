"""Typed tables on disk: declared schemas and keys, CSV in, Parquet out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cutline.functions.scalars import NULL_TOKEN


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType()}


def schema(columns: str) -> T.StructType:
    """The schema that a list of names and types describes."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


# The columns of every table of the dump, in its order.
COLUMNS: dict[str, str] = {
    "circuits": (
        "circuitId int, circuitRef string, name string, location string, country string, lat double, lng double, "
        "alt double, url string"),
    "constructor_results": "constructorResultsId int, raceId int, constructorId int, points double, status string",
    "constructor_standings": (
        "constructorStandingsId int, raceId int, constructorId int, points double, position int, positionText string, "
        "wins int"),
    "constructors": "constructorId int, constructorRef string, name string, nationality string, url string",
    "driver_standings": "driverStandingsId int, raceId int, driverId int, points double, position int, positionText string, wins int",
    "drivers": (
        "driverId int, driverRef string, number int, code string, forename string, surname string, dob date, "
        "nationality string, url string"),
    "lap_times": "raceId int, driverId int, lap int, position int, time string, milliseconds bigint",
    "pit_stops": "raceId int, driverId int, stop int, lap int, time string, duration string, milliseconds bigint",
    "qualifying": (
        "qualifyId int, raceId int, driverId int, constructorId int, number int, position int, q1 string, q2 string, "
        "q3 string"),
    "races": (
        "raceId int, year int, round int, circuitId int, name string, date date, time string, url string, "
        "fp1_date string, fp1_time string, fp2_date string, fp2_time string, fp3_date string, fp3_time string, "
        "quali_date string, quali_time string, sprint_date string, sprint_time string"),
    "results": (
        "resultId int, raceId int, driverId int, constructorId int, number int, grid int, position int, "
        "positionText string, positionOrder int, points double, laps int, time string, milliseconds bigint, "
        "fastestLap int, rank int, fastestLapTime string, fastestLapSpeed double, statusId int"),
    "seasons": "year int, url string",
    "sprint_results": (
        "resultId int, raceId int, driverId int, constructorId int, number int, grid int, position int, "
        "positionText string, positionOrder int, points double, laps int, time string, milliseconds bigint, "
        "fastestLap int, fastestLapTime string, statusId int"),
    "status": "statusId int, status string",
}
SCHEMAS: dict[str, T.StructType] = {name: schema(columns) for name, columns in COLUMNS.items()}
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "circuits": ("circuitId",), "constructor_results": ("constructorResultsId",),
    "constructor_standings": ("constructorStandingsId",), "constructors": ("constructorId",),
    "driver_standings": ("driverStandingsId",), "drivers": ("driverId",), "lap_times": ("raceId", "driverId", "lap"),
    "pit_stops": ("raceId", "driverId", "stop"), "qualifying": ("qualifyId",), "races": ("raceId",), "results": ("resultId",),
    "seasons": ("year",), "sprint_results": ("resultId",), "status": ("statusId",),
}


def foreign_keys() -> list[tuple[str, str, str]]:
    """(table, column, parent): a column that is another table's whole key refers to it."""
    parents = {keys[0]: t for t, keys in PRIMARY_KEYS.items() if len(keys) == 1 and t not in ("results", "sprint_results", "qualifying")
               and not t.startswith(("constructor_", "driver_"))}
    return [(t, c, parents[c]) for t, s in SCHEMAS.items() for c in s.names if c in parents and parents[c] != t]


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, empty_is_null: bool = False, extra: bool = False) -> DataFrame:
    """CSV files of one header, or a folder of them. The null token is the only null; an empty text
    stays visible unless `empty_is_null`. With `extra`, columns beyond the schema are read as text."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.read.option("header", True).option("nullValue", NULL_TOKEN).option("emptyValue", "").option("escape", '"')
    raw = reader.csv(path) if extra else reader.schema(text_schema).csv(path)
    raw = raw.select(*[F.when(F.col(c) == NULL_TOKEN, None).otherwise(F.col(c)).alias(c) for c in raw.columns])
    types = {f.name: f.dataType for f in schema.fields}

    def typed(c: str):
        if isinstance(types.get(c, T.StringType()), T.StringType):
            return (F.nullif(F.col(c), F.lit("")) if empty_is_null else F.coalesce(F.col(c), F.lit(None))).alias(c)
        whole = isinstance(types[c], (T.IntegerType, T.LongType))
        # A nullable integer may be written as 3.0.
        value = F.trim(F.col(c)).try_cast("double").try_cast(types[c]) if whole else F.trim(F.col(c)).try_cast(types[c])
        return value.alias(c)

    return raw.select(*[typed(c) for c in raw.columns])


def read_table(spark: SparkSession, name: str, folder: str, empty_is_null: bool = False) -> DataFrame:
    return read_csv(spark, f"{folder}/{name}.csv", SCHEMAS[name], empty_is_null)


def read_all(spark: SparkSession, folder: str, views: bool = True) -> dict[str, DataFrame]:
    """Every table by name, also as temporary views."""
    out = {name: read_table(spark, name, folder) for name in SCHEMAS}
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def read_seasons(spark: SparkSession, files: Sequence[str], schema: T.StructType) -> DataFrame:
    """One table kept as a file per season; a column some seasons lack is null there.

    Files with the same header are one read, so the plan grows with the different headers, not with the files."""
    lines = spark.read.text(list(files)).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("_at"))
    groups: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "_at").alias("header")).orderBy("file").collect():  # a row per file
        groups.setdefault(r["header"], []).append(r["file"])
    parts = [read_csv(spark, paths, schema, empty_is_null=True, extra=True) for paths in groups.values()]
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_table(df: DataFrame, path: str, order_by: Sequence[str], season: str | None = None) -> None:
    """Write Parquet in a total order: by range over the files and sorted within each, one
    folder per season where there is one. Nothing passes through a single task."""
    keys = [season, *order_by] if season else list(order_by)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(season) if season else writer).parquet(path)


def write_season(df: DataFrame, path: str, season: str, order_by: Sequence[str]) -> None:
    """Replace only the seasons present in the frame."""
    df.repartitionByRange(season, *order_by).sortWithinPartitions(season, *order_by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def unparseable(df: DataFrame, column: str, parsed, keys: Sequence[str]) -> DataFrame:
    """Rows whose text is present but does not parse."""
    return df.where(F.col(column).isNotNull() & (F.trim(column) != "") & parsed.isNull()).select(*keys, column)


def widen_union(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union by name with missing columns null, each row tagged with its source."""
    out = None
    for source, df in tables:
        tagged = df.withColumn("source", F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
