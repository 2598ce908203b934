"""The star-schema tables in the roles of events, entries, sessions and dimensions.

An order is an event, a supplier an entity that enters it, the supplier's nation
its group and the order priority the venue. `ord` orders events strictly: the
day number in the high digits and the order key below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cutline.functions import scalars as S
from cutline.session import stored
from cutline.operators.spans import SAMPLES_PER_SPAN, Spans, numbered, plan_spans, span_limit

ORD_SCALE = 1_000_000_000_000
# Keys that are a column of a source table, whatever frame of it they group.
SOURCE_KEYS = {"lineitem": {"event": "l_orderkey", "l_orderkey": "l_orderkey", "entity": "l_suppkey"}, "orders": {"event": "o_orderkey"}}
ERAS = [(1995, 1996, "first"), (1997, 1999, "second"), (2000, None, "third")]


def day_number(date: Column) -> Column:
    return F.unix_date(F.to_date(date)).cast("bigint")


def clock_text(ms: Column) -> Column:
    """Milliseconds, which are not negative, as `M:SS.mmm`; unknown ones are written as null."""
    def part(n: Column, places: int) -> Column:
        return F.lpad(n.cast("string"), places, "0")

    shown = F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), part(F.floor(ms % 60000 / 1000), 2), F.lit("."), part(ms % 1000, 3))
    return F.coalesce(shown, F.lit("null:null.null"))


@dataclass
class Star:
    spark: SparkSession
    path: str
    _rows: dict[str, int] = field(default_factory=dict)
    _even: dict[tuple[str, str, int], bool] = field(default_factory=dict)
    _raw: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count of a table, read from the Parquet footers."""
        if name not in self._rows:
            self._rows[name] = self.table(name).count()
        return self._rows[name]

    def spans(self, df: DataFrame, keys: list[str], order: str, table: str = "lineitem", times: int = 1) -> Spans:
        """Spans of a frame that has at most `times` the rows of a source table, also by event and entity. Where that table has no large
        event nothing that is grouped by event is cut, and the frame need not be computed to know it; the same for entities."""
        if not self.looks(df, keys, table, times):
            return Spans(tuple(keys), order)
        return plan_spans(df, keys, order, rows=self.rows(table) * times)

    def looks(self, df: DataFrame, keys: list[str], table: str = "lineitem", times: int = 1) -> bool:
        """Whether `spans` must compute the frame to find its large groups."""
        limit = span_limit(df)
        known = [c for k, c in SOURCE_KEYS.get(table, {}).items() if k in keys]
        return self.rows(table) * times > limit and not any(self.even(table, c, max(1, limit // times)) for c in known)

    def even(self, table: str, column: str, limit: int) -> bool:
        """Whether no value of a source table's column has more rows than the limit, by a sample as dense as that of `plan_spans`."""
        if (table, column, limit) not in self._even:
            fraction = min(1.0, SAMPLES_PER_SPAN / limit)
            drawn = self.table(table).select(column).sample(fraction, seed=7).groupBy(column).count()
            self._even[table, column, limit] = drawn.where(F.col("count") >= max(1, round(limit * fraction))).isEmpty()
        return self._even[table, column, limit]

    def planner(self, table: str = "lineitem", times: int = 1):
        """`spans` as a function of the frame, its keys and its ordering column; its `looks` says whether it computes the frame."""
        def plan(df: DataFrame, keys: list[str], order: str) -> Spans:
            return self.spans(df, keys, order, table, times)

        plan.looks = lambda df, keys: self.looks(df, keys, table, times)
        return plan

    def events(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("event"),
            (day_number(F.col("o_orderdate")) * ORD_SCALE + F.col("o_orderkey")).alias("ord"),
            F.year("o_orderdate").cast("bigint").alias("season"),
            F.month("o_orderdate").cast("bigint").alias("round"),
            F.col("o_orderpriority").alias("venue"),
            (F.col("o_orderstatus") == "P").alias("short"),
        )

    def raw_entries(self) -> DataFrame:
        """One row per (event, entity): the best line where a supplier repeats.

        Where no event is large, lines are shuffled once by event, and the ranking
        of an event reuses that. A large event is first reduced by entity."""
        best = F.max(F.struct(
            F.col("l_extendedprice").alias("pace"), (-F.col("l_partkey")).alias("part"),
            (-F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("points"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        ))
        lines = self.table("lineitem")
        if self.spans(lines, ["l_orderkey"], "l_extendedprice").cuts is None:
            lines = lines.repartition("l_orderkey")
        best_lines = lines.groupBy(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("entity")).agg(best.alias("b"))
        retired = F.col("b.flag") == "R"
        return best_lines.select(
            "event", "entity", F.col("b.pace").alias("pace"), (-F.col("b.line")).cast("bigint").alias("line"),
            F.when(F.col("b.discount") >= 0.1, 0).otherwise(-F.col("b.line")).cast("bigint").alias("grid"),
            F.col("b.points").alias("points"),
            retired.alias("out"),
            F.when(retired & (F.col("b.status") == "O"), S.WITHDRAWN).when(retired, S.RETIRED).alias("_code"),
        )

    def keep_raw(self) -> "Star":
        """Write the raw entries once, for results and qualifying to read."""
        self._raw = stored(self.raw_entries(), "raw-entries")
        return self

    def raw(self) -> DataFrame:
        return self.raw_entries() if self._raw is None else self._raw

    def results(self, qualifying: bool = False) -> DataFrame:
        """Entries with their finishing order: finishers by pace, then the rest; and, if asked, with their place in qualifying, which
        the same exchange by event serves."""
        raw = self.raw()
        if qualifying:
            raw = numbered(raw, self.spans(raw, ["event"], "line"), "quali_position", ties=[F.col("entity")])
        raw = raw.withColumn(
            "_key", F.when(F.col("out"), 1e9).otherwise(0.0) - F.col("pace"))
        spans = self.spans(raw, ["event"], "_key")
        ranked = numbered(raw, spans, "finish", ties=[F.col("entity")]).drop("_key")
        return ranked.withColumn("code", F.coalesce("_code", F.col("finish").cast("string"))).drop("_code", "out")

    def entries(self, qualifying: bool = False) -> DataFrame:
        """Results with the event's order, season, round and venue, and the entity's group."""
        groups = self.table("supplier").select(
            F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("bigint").alias("grp"))
        return (
            self.results(qualifying).join(self.events().drop("short"), "event").join(groups, "entity", "left")
            .withColumn("retired", S.is_retired(F.col("code")))
        )

    def qualifying(self) -> DataFrame:
        """Qualifying position and up to three session times per entry, as text."""
        base = (F.lit(80000) + F.floor(F.col("pace") * 10) % 20000).cast("bigint")
        raw = self.raw().select(
            "event", "entity", "line", clock_text(base + 500).alias("q1"), clock_text(base + 200).alias("q2"),
            clock_text(base).alias("q3"))
        ranked = numbered(raw, self.spans(raw, ["event"], "line"), "position", ties=[F.col("entity")])
        return ranked.select(
            "event", "entity", "position", "q1", F.when(F.col("position") <= 5, F.col("q2")).alias("q2"),
            F.when(F.col("position") <= 3, F.col("q3")).alias("q3"))

    def laps(self) -> DataFrame:
        """Practice laps of an event: each raw line is a stint of one to nine laps, some of them inaccurate or not under green.

        Where no event is large, lines are exchanged by event before each becomes its laps, and what groups by event reuses that."""
        whole = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus")
        if self.spans(whole, ["l_orderkey"], "l_extendedprice", times=9).cuts is None:
            whole = whole.repartition("l_orderkey")
        lines = whole.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor("l_quantity").cast("bigint") % 9)).alias("lap"))
        return lines.select(
            F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("entity"),
            (F.col("l_partkey") % 3 + 1).alias("session"),
            F.col("l_linenumber").cast("bigint").alias("stint"),
            (F.floor(F.col("l_extendedprice") * 10).cast("bigint") + F.col("l_partkey") * (F.col("lap") + 1) % 500).alias("lap_ms"),
            ((F.col("l_partkey") + F.col("lap")) % 13 != 0).alias("accurate"),
            ((F.col("l_linestatus") == "F") | (F.col("lap") > 0)).alias("green"),
            F.when(F.col("l_partkey") % 4 == 0, "SOFT").when(F.col("l_partkey") % 4 == 1, "MEDIUM")
            .when(F.col("l_partkey") % 4 == 2, "HARD").otherwise("WET").alias("compound"),
        )

    def session_laps(self, days: int = 10) -> DataFrame:
        """Laps of the `events` table: a block of days is the event, a user the entity,
        the event type the session and the half day the stint."""
        e = self.table("events")
        k = F.get_json_object("props", "$.k").try_cast("int")
        return e.select(
            F.floor(F.unix_date(F.to_date("ts")) / days).cast("bigint").alias("event"),
            F.col("user_id").alias("entity"), F.col("event_type").alias("session"),
            F.when(F.hour("ts") < 12, 0).otherwise(1).cast("bigint").alias("stint"),
            F.round(F.col("value") * 1000).cast("bigint").alias("lap_ms"),
            (k % 10 != 0).alias("accurate"), (k % 7 != 0).alias("green"),
            F.when(k % 4 == 0, "SOFT").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "HARD").otherwise("WET").alias("compound"),
        )

    def eras(self) -> DataFrame:
        return self.spark.createDataFrame(ERAS, "first_season bigint, last_season bigint, era string")

    def feature_tables(self):
        """The event tables, each written once because every part of the frame reads them."""
        from cutline.operators.dense import standings
        from cutline.plans.features import EventTables

        entries, plan = stored(self.keep_raw().entries(), "entries"), self.planner()
        table_plan = self.planner(times=12)
        return EventTables(
            events=self.events(), entries=entries, qualifying=stored(self.qualifying(), "qualifying"), laps=self.laps(),
            eras=self.eras(), entity_standings=stored(standings(entries, self.events(), "entity", table_plan), "entity-standings"),
            group_standings=stored(standings(entries, self.events(), "grp", table_plan), "group-standings"),
            plan=plan, plan_events=self.planner("orders"))
