"""Queries of the sources: files and pages written from the tables by Spark, read back by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions import scalars as S
from cutline.functions import text as X
from cutline.operators import checks as C
from cutline.operators import corrections as K
from cutline.operators import diff, lookup
from cutline.plans import evaluate, record
from cutline.registry import ENTRIES, EVENTS, query
from cutline.session import stored
from cutline.sources import pages as G
from cutline.sources import sessions as Z
from cutline.sources import tables as B
from cutline.sources.star import Star
from cutline.streaming.streams import work_folder


# ------------------------------------------------------------------ CSV files
@query("csv_table", """
SELECT CAST(p_partkey AS INTEGER) AS "driverId", CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS "driverRef",
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS number, 'a "b", ' || p_brand AS code
FROM part""")
def csv_table(star: Star) -> DataFrame:
    """A table written as text with the null token, quotes and whole numbers as decimals, and read with its declared types."""
    p, folder = star.table("part"), work_folder(star.spark, "csv")
    key = F.col("p_partkey")
    text = p.select(key.cast("string").alias("driverId"), F.when(key % 5 == 0, S.NULL_TOKEN).when(key % 7 == 0, "").otherwise(F.col("p_name")).alias("driverRef"),
                    F.when(key % 3 == 0, S.NULL_TOKEN).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("number"),
                    F.concat(F.lit('a "b", '), "p_brand").alias("code"),
                    *[F.lit(S.NULL_TOKEN).alias(c) for c in ("forename", "surname", "dob", "nationality", "url")])
    text.write.option("header", True).option("escape", '"').csv(f"{folder}/drivers.csv")
    return B.read_table(star.spark, "drivers", folder).select("driverId", "driverRef", "number", "code")


@query("season_files", """
SELECT o_orderkey AS "raceId", CASE WHEN year(o_orderdate) >= 2000 THEN o_orderstatus END AS compound, CAST(o_custkey AS INTEGER) AS lap FROM orders""")
def season_files(star: Star) -> DataFrame:
    """A file per season, of which only later ones have the third column, written in order and read as one table."""
    folder = work_folder(star.spark, "seasons")
    o = star.table("orders").select(F.col("o_orderkey").alias("raceId"), F.col("o_custkey").alias("lap"), F.col("o_orderstatus").alias("compound"), F.year("o_orderdate").alias("season"))
    for name, rows in (("early", o.where("season < 2000").drop("compound")), ("late", o.where("season >= 2000"))):
        rows.repartition("season").sortWithinPartitions("season", "raceId").write.partitionBy("season").option("header", True).csv(f"{folder}/{name}")
    files = [f"{folder}/{name}" for name in ("early", "late")]
    listed = star.spark.read.option("recursiveFileLookup", True).format("binaryFile").load(files).select("path").orderBy("path")
    paths = [r["path"] for r in listed.collect() if r["path"].endswith(".csv")]  # one file for each season
    return B.read_seasons(star.spark, paths, B.schema("raceId bigint, lap int, compound string")).select("raceId", "lap", "compound")


@query("sorted_sink", """SELECT season, event, venue FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderkey AS event, o_orderpriority AS venue FROM orders)""")
def sorted_sink(star: Star) -> DataFrame:
    """The events, written in order in a folder per season, one season written again, and read back."""
    folder = f"{work_folder(star.spark, 'sink')}/events"
    events = star.events().select("season", "event", "venue")
    B.write_table(events, folder, ["event"], "season")
    B.write_season(events.where("season = 1998"), folder, "season", ["event"])
    return star.spark.read.parquet(folder).select(F.col("season").cast("bigint").alias("season"), "event", "venue")


# ------------------------------------------------------------------ paged JSON
def _clock(ms: Column) -> Column:
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


ROWS_A_PAGE = 2_000  # about; an aggregation holds up to 128 pages at once before it sorts, so this bounds what a task holds


def paged(star: Star, rows: DataFrame, endpoint: str, item: Column, pages: int = 3, rows_a_page: int = ROWS_A_PAGE) -> tuple[DataFrame, DataFrame]:
    """Write rows (season, event) as the pages of one request per season, events cut across `pages` of them, and read them back.
    A season with many rows has as many such groups of pages as keep a page near `rows_a_page`."""
    table, list_, inner, _ = G.SHAPES[endpoint]
    folder = work_folder(star.spark, f"pages-{endpoint}")
    groups = rows.groupBy("season").agg(F.ceil(F.count("*") / (pages * rows_a_page)).alias("_groups"))
    page = F.pmod(F.xxhash64("event"), F.col("_groups")) * pages + F.pmod(F.xxhash64("event", "entity"), F.lit(pages))
    placed = rows.join(F.broadcast(groups), "season").select("season", "event", page.alias("page"), item.alias("row"))
    totals = rows.groupBy("season").agg(F.count("*").cast("string").alias("total"))
    races = placed.groupBy("season", "page", "event").agg(F.collect_list("row").alias(inner))
    body = races.join(totals, "season").groupBy("season", "page", "total").agg(F.collect_list(F.struct(
        F.col("season").cast("string").alias("season"), F.col("event").cast("string").alias("round"), F.col(inner))).alias(list_))
    whole = body.select("season", "page", F.struct("total", F.struct(F.col(list_)).alias(table)).alias("MRData"))
    whole.repartition("season", "page").write.partitionBy("season", "page").option("ignoreNullFields", False).json(folder)
    found = G.read_pages(star.spark, folder, endpoint).withColumn("request", F.regexp_replace("request", "/page=.*$", ""))
    return stored(found, "pages"), placed


def ids(star: Star, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = events.select("season", F.col("event").alias("round"), "event").distinct()
    s = star.table("supplier")
    return known, s.select(F.concat(F.lit("e"), "s_suppkey").alias("ref"), F.col("s_suppkey").alias("entity")), s.select(
        F.concat(F.lit("g"), "s_nationkey").alias("ref"), F.col("s_nationkey").cast("bigint").alias("entity")).distinct()


def _entries(star: Star) -> DataFrame:
    return stored(star.entries(), "page-entries")


@query("page_results", f"""
WITH {ENTRIES}
SELECT event, entity, grp, CAST(grid AS INTEGER) AS grid, CASE WHEN code NOT IN ('R', 'W') THEN CAST(finish AS INTEGER) END AS position, code AS position_text,
  CAST(finish AS INTEGER) AS position_order, points, CAST(line AS INTEGER) AS laps, grid = 0 AS pit_lane_start FROM entries""")
def page_results(star: Star) -> DataFrame:
    """Results from pages that cut events apart; each request must hold as many rows as it declares."""
    e = _entries(star)
    item = F.struct(F.struct(F.concat(F.lit("e"), "entity").alias("driverId")).alias("Driver"), F.struct(F.concat(F.lit("g"), "grp").alias("constructorId")).alias("Constructor"),
                    F.col("finish").cast("string").alias("position"), F.col("code").alias("positionText"), F.col("points").cast("string").alias("points"),
                    F.col("grid").cast("string").alias("grid"), F.col("line").cast("string").alias("laps"))
    pages, _ = paged(star, e, "results", item)
    rows = stored(G.page_rows(pages, "results"), "page-rows")
    G.require_complete(pages, rows)
    return G.results_table(rows, *ids(star, e)).select("event", "entity", "grp", "grid", "position", "position_text", "position_order", "points", "laps", "pit_lane_start")


@query("page_laps", f"""
WITH {ENTRIES}
SELECT event, entity, CAST(line AS INTEGER) AS lap, CAST(finish AS INTEGER) AS position, 60000 + CAST(floor(pace * 10) AS BIGINT) % 40000 AS milliseconds FROM entries""")
def page_laps(star: Star) -> DataFrame:
    """Laps, whose timings are a second level of nesting."""
    e = _entries(star).withColumn("ms", (F.lit(60000) + F.floor(F.col("pace") * 10) % 40000).cast("bigint"))
    item = F.struct(F.col("line").cast("string").alias("number"), F.array(F.struct(
        F.concat(F.lit("e"), "entity").alias("driverId"), F.col("finish").cast("string").alias("position"), _clock(F.col("ms")).alias("time"))).alias("Timings"))
    pages, _ = paged(star, e, "laps", item)
    rows = stored(G.page_rows(pages, "laps"), "page-rows")
    G.require_complete(pages, rows)
    events, entities, _ = ids(star, e)
    return G.laps_table(rows, events, entities).select("event", "entity", "lap", "position", "milliseconds")


@query("page_pit_stops", f"""
WITH {ENTRIES}, s AS (SELECT *, CAST(floor(pace * 10) AS BIGINT) % 400000 AS ms FROM entries)
SELECT event, entity, CAST(finish AS INTEGER) AS stop, CAST(line AS INTEGER) AS lap, ms AS milliseconds, ms >= 180000 AS suspended FROM s""")
def page_pit_stops(star: Star) -> DataFrame:
    """Pit stops; one as long as a suspension of the race is marked."""
    e = _entries(star).withColumn("ms", (F.floor(F.col("pace") * 10) % 400000).cast("bigint"))
    item = F.struct(F.concat(F.lit("e"), "entity").alias("driverId"), F.col("finish").cast("string").alias("stop"), F.col("line").cast("string").alias("lap"),
                    F.lit("13:00:00").alias("time"), _clock(F.col("ms")).alias("duration"))
    pages, _ = paged(star, e, "pitstops", item)
    events, entities, _ = ids(star, e)
    return G.pit_stops_table(G.page_rows(pages, "pitstops"), events, entities).select("event", "entity", "stop", "lap", "milliseconds", "suspended")


@query("page_standings", f"""
WITH {ENTRIES}
SELECT event, entity, points, CAST(finish AS INTEGER) AS position, code AS position_text, CAST(code = '1' AS INTEGER) AS wins FROM entries""")
def page_standings(star: Star) -> DataFrame:
    e = _entries(star)
    item = F.struct(F.col("finish").cast("string").alias("position"), F.col("code").alias("positionText"), F.col("points").cast("string").alias("points"),
                    (F.col("code") == "1").cast("int").cast("string").alias("wins"), F.struct(F.concat(F.lit("e"), "entity").alias("driverId")).alias("Driver"))
    pages, _ = paged(star, e, "driverstandings", item)
    events, entities, _ = ids(star, e)
    return G.standings_table(G.page_rows(pages, "driverstandings"), events, entities, None)


@query("page_qualifying", f"""
WITH {ENTRIES}
SELECT event, entity, grp, CAST(finish AS INTEGER) AS position, 'q' || finish AS q1, CASE WHEN finish <= 2 THEN 'q' || line END AS q2 FROM entries""")
def page_qualifying(star: Star) -> DataFrame:
    e = _entries(star)
    item = F.struct(F.struct(F.concat(F.lit("e"), "entity").alias("driverId")).alias("Driver"), F.struct(F.concat(F.lit("g"), "grp").alias("constructorId")).alias("Constructor"),
                    F.col("finish").cast("string").alias("position"), F.concat(F.lit("q"), "finish").alias("Q1"), F.when(F.col("finish") <= 2, F.concat(F.lit("q"), "line")).alias("Q2"))
    pages, _ = paged(star, e, "qualifying", item)
    return G.qualifying_table(G.page_rows(pages, "qualifying"), *ids(star, e)).select("event", "entity", "grp", "position", "q1", "q2")


@query("short_pages", f"""
WITH {EVENTS}
SELECT season, count(*) AS total, count(*) - count(*) FILTER (event % 1000 = 0) AS rows FROM ev GROUP BY season HAVING count(*) FILTER (event % 1000 = 0) > 0""")
def short_pages(star: Star) -> DataFrame:
    """Requests that do not add up to their declared total: every thousandth event's row was lost."""
    e = star.events().withColumn("entity", F.lit(0))
    pages, _ = paged(star, e, "driverstandings", F.struct(F.col("event").cast("string").alias("position")))
    found = G.incomplete(pages, G.page_rows(pages, "driverstandings").where(F.col("round") % 1000 != 0))
    return found.select(F.regexp_extract("request", "season=([0-9]+)", 1).cast("bigint").alias("season"), "total", "rows")


# ------------------------------------------------------------------ grid pages
GRID = """
named AS (SELECT event, entity, finish, chr(CAST(65 + entity % 26 AS INTEGER)) || chr(CAST(65 + entity // 26 % 26 AS INTEGER)) || chr(CAST(65 + entity // 676 % 26 AS INTEGER)) AS code FROM entries),
listed AS (SELECT event, code, min(finish) AS grid FROM named GROUP BY event, code)"""


@query("grid_pages", f"""
WITH {ENTRIES}, {GRID},
first AS (SELECT event, code AS one FROM named WHERE finish = 1)
SELECT l.event AS page_id, CAST(l.grid AS INTEGER) AS grid, 'Jo ' || l.code || lower(l.code) AS name, l.code,
  CASE WHEN l.event % 3 = 0 THEN l.code = f.one WHEN l.event % 3 = 2 THEN false END AS pit_lane_start,
  CASE WHEN l.event % 3 = 0 AND l.code = f.one THEN 'sentence' WHEN l.event % 3 = 1 THEN 'unresolved' ELSE 'none' END AS attribution
FROM listed l LEFT JOIN first f ON f.event = l.event WHERE l.grid < 100""")
def grid_pages(star: Star) -> DataFrame:
    """Starting grids read from a page's text, and who its note says starts from the pit lane: the named one, or nobody known."""
    e = _entries(star)
    letter = [F.char((65 + F.floor(F.col("entity") / d) % 26).cast("int")) for d in (1, 26, 676)]
    code = F.concat(*letter)
    surname = F.concat(code, F.lower(code))
    line = F.format_string("<tr><td>%d</td><td>%d</td><td>Jo %s</td><td>%s</td><td>1:%02d.0</td></tr>", "finish", F.col("entity") % 90 + 1, surname, code, F.col("finish") % 60)
    note = (F.when(F.col("event") % 3 == 0, F.concat(F.lit("<p>Note: a delay. "), "first", F.lit(" will start from the PIT lane.</p>")))
            .when(F.col("event") % 3 == 1, "<p>Note - required to start from the pit lane.</p>").otherwise(""))
    html = e.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("finish", line.alias("line")))).alias("lines"), F.min_by(surname, "finish").alias("first")).select(
        F.col("event").alias("page_id"), F.concat(F.lit("<html><table>"), F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("</table>"), note, F.lit(" OUR PARTNERS</html>")).alias("html"))
    pages = stored(html.select("page_id", X.page_text(F.col("html")).alias("text")), "grid-pages")
    verified = star.spark.createDataFrame([], "page_id bigint, code string")
    return X.attribute_notes(X.grid_rows(pages), X.notes(pages), verified).select("page_id", "grid", "name", "code", "pit_lane_start", "attribution")


# ------------------------------------------------------------------ columns and lookups
@query("encoded_positions", f"""
WITH {ENTRIES}
SELECT event, entity, CASE WHEN code NOT IN ('R', 'W') THEN CAST(finish AS INTEGER) END AS position, CASE WHEN entity % 11 = 0 THEN '' ELSE code END AS position_text,
  CASE WHEN entity % 7 <> 0 THEN CAST(finish AS INTEGER) END AS position_order
FROM entries WHERE entity % 11 <> 0 UNION ALL
SELECT event, entity, NULL, '', CASE WHEN entity % 7 <> 0 THEN CAST(finish AS INTEGER) END FROM entries WHERE entity % 11 = 0""")
def encoded_positions(star: Star) -> DataFrame:
    rank = F.when(F.col("entity") % 7 == 0, " ").otherwise(F.col("finish").cast("string"))
    text = F.when(F.col("entity") % 11 != 0, F.col("code"))
    return star.entries().select("event", "entity", *[c.alias(n) for n, c in S.encode_position(rank, text).items()])


@query("stand_in_keys", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown_2026_r' || c_nationkey || '_practice1_' || c_custkey ELSE '2026_' || replace(lower(trim(c_name)), ' ', '_') END AS stand_in FROM customer""")
def stand_in_keys(star: Star) -> DataFrame:
    name = F.when(F.col("c_custkey") % 8 == 0, "NaN").when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    key = S.stand_in_key(F.lit(2026), name, F.col("c_nationkey"), F.lit("Practice 1"), F.col("c_custkey"))
    return star.table("customer").select("c_custkey", key.alias("stand_in"))


@query("position_basis", f"""
WITH {ENTRIES}, q AS (SELECT event, entity, least(greatest(coalesce(CAST(nullif(grid, 0) AS DOUBLE), 20.0), 1.0), 22.0) AS h FROM entries)
SELECT event, entity, round(ln(h), 6) AS q_log, {', '.join(f'pow(greatest(h - {k}, 0.0), 3.0) AS q_h{i}' for i, k in enumerate(S.KNOTS[:-1]))} FROM q""")
def position_basis(star: Star) -> DataFrame:
    basis = S.spline_basis(F.when(F.col("grid") > 0, F.col("grid")))
    return star.entries().select("event", "entity", *[(F.round(c, 6) if n == "q_log" else c).alias(n) for n, c in basis.items()])


@query("position_one_hot", f"""
WITH {ENTRIES} SELECT event, entity, {', '.join(f'CAST(least(greatest(grid, 0), 20) = {k} AS DOUBLE) AS q_{k}' for k in range(1, 21))} FROM entries""")
def position_one_hot(star: Star) -> DataFrame:
    """A column for each of twenty places, all 0 for an unknown one."""
    return star.entries().select("event", "entity", *[c.alias(n) for n, c in S.one_hot_basis(F.col("grid")).items()])


@query("preferred_by_key", """
SELECT c_custkey, s_suppkey, s_acctbal FROM customer LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) s ON c_nationkey = s_nationkey""")
def preferred_by_key(star: Star) -> DataFrame:
    """A payload by key; where a key repeats, the preferred row."""
    s = star.table("supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    return lookup.key_lookup(star.table("customer"), s, ["c_nationkey"], ["s_suppkey", "s_acctbal"], F.struct(-F.col("s_acctbal"), "s_suppkey")).select(
        "c_custkey", "s_suppkey", "s_acctbal")


@query("unmatched_keys", """
SELECT n_nationkey, count(s_suppkey) AS matches FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1 HAVING count(s_suppkey) <> 1""")
def unmatched_keys(star: Star) -> DataFrame:
    """Keys whose lookup does not give exactly one row."""
    joined = star.table("nation").join(star.table("supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return lookup.match_counts(joined, ["n_nationkey"], "s_suppkey")


# ------------------------------------------------------------------ dimensions, rules and evidence
@query("attribute_conflicts", """
WITH b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN lower(p_brand) ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 0)
SELECT p_partkey, 'p_brand' AS "column", a.p_brand AS known, b.p_brand AS seen FROM part a JOIN b USING (p_partkey) WHERE a.p_brand <> b.p_brand
UNION ALL SELECT p_partkey, 'p_size', CAST(a.p_size AS VARCHAR), CAST(b.p_size AS VARCHAR) FROM part a JOIN b USING (p_partkey) WHERE a.p_size <> b.p_size""")
def attribute_conflicts(star: Star) -> DataFrame:
    """Attributes of matched parts that a second source states differently."""
    p, key = star.table("part"), F.col("p_partkey")
    seen = p.where(key % 10 != 0).select(
        "p_partkey", "p_name", F.when(key % 9 == 0, None).when(key % 4 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(key % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return diff.attribute_conflicts(p, seen, "p_partkey", ["p_name", "p_brand", "p_size"])


@query("value_status", """
WITH known AS (SELECT * FROM part WHERE p_partkey % 10 <> 3), seen AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN upper(p_type) || '.' ELSE p_type END AS v FROM part)
SELECT p_partkey, v AS seen, p_type AS known, CASE WHEN known.p_partkey IS NULL THEN 'new' WHEN v = p_type THEN 'same' ELSE 'conflict' END AS status
FROM seen LEFT JOIN known USING (p_partkey)""")
def value_status(star: Star) -> DataFrame:
    """Each label of a second source as the same, in conflict or new."""
    p, key = star.table("part"), F.col("p_partkey")
    seen = p.select("p_partkey", F.when(key % 8 == 0, F.concat(F.upper("p_type"), F.lit("."))).otherwise(F.col("p_type")).alias("p_type"))
    return diff.value_status(p.where(key % 10 != 3), seen, "p_partkey", "p_type")


@query("refused_corrections", """
SELECT CAST(o_orderkey AS VARCHAR) AS primary_key, CASE WHEN o_orderkey % 3 = 0 THEN 'no evidence source' ELSE 'unknown evidence type' END AS problem FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'P'""")
def refused_corrections(star: Star) -> DataFrame:
    """Corrections without evidence, or with evidence of no agreed kind."""
    key = F.col("o_orderkey")
    rows = star.table("orders").select(
        F.lit("orders").alias("table"), key.cast("string").alias("primary_key"), F.lit("o_orderstatus").alias("column"), F.lit("*").alias("old_value"), F.lit("F").alias("new_value"),
        F.lit("why").alias("reason"), F.when(F.col("o_orderstatus") == "P", "rumour").when(F.col("o_orderstatus") == "O", "internal").otherwise("official").alias("evidence_type"),
        F.when(key % 6 == 0, " ").when(key % 3 != 0, "register").alias("evidence_source"))
    return K.rule_violations(rows).select("primary_key", "problem")


@query("broken_sequences", """
SELECT l_orderkey AS event, l_suppkey AS entity, count(*) AS rows FROM lineitem GROUP BY 1, 2
HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))""")
def broken_sequences(star: Star) -> DataFrame:
    """Entities whose numbers in an event are not 1, 2, ... without a gap."""
    lines = star.table("lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("entity"), "l_linenumber")
    return C.not_dense(lines, ["event", "entity"], "l_linenumber").select("event", "entity", "rows")


@query("unparseable_times", """SELECT o_orderkey, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 = 0""")
def unparseable_times(star: Star) -> DataFrame:
    """Texts that are there and are no duration."""
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 5 == 1, " ").when(F.col("o_orderkey") % 5 == 2, "1:02.5")
    rows = star.table("orders").select("o_orderkey", text.alias("text"))
    return B.unparseable(rows, "text", S.duration_ms(F.col("text")), ["o_orderkey"])


@query("augmented_history", f"""
WITH {ENTRIES}
SELECT event, entity, points FROM entries UNION ALL SELECT -1, s_suppkey, CAST(NULL AS DOUBLE) FROM supplier WHERE s_acctbal > 0""")
def augmented_history(star: Star) -> DataFrame:
    """The entries with those of an event that has not run, under a provisional key."""
    s = star.table("supplier").select(F.concat(F.lit("ref"), "s_suppkey").alias("ref"), F.col("s_suppkey").alias("entity"), "s_acctbal")
    return record.upcoming_rows(s.where("s_acctbal > 0").select("ref"), star.entries().select("event", "entity", "points"), s.select("ref", "entity"), -1)


@query("reviewed_stand_ins", """
WITH a AS (SELECT c_custkey AS number, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS team, c_nationkey AS event FROM customer)
SELECT number, CASE WHEN name IS NULL AND number % 2 = 0 THEN 'Off ' || number ELSE name END AS name,
  CASE WHEN name IS NULL AND number % 2 = 0 THEN 7 WHEN team = 'BUILDING' THEN 1 WHEN team = 'MACHINERY' THEN 2 END AS grp,
  CASE WHEN name IS NULL AND number % 2 = 0 THEN 'official classification' WHEN team IN ('BUILDING', 'MACHINERY') THEN 'reviewed map' ELSE 'unresolved' END AS source
FROM a""")
def reviewed_stand_ins(star: Star) -> DataFrame:
    """Participants without an id get their group from the official classification or a reviewed map of team names."""
    c = star.table("customer")
    who = c.select(F.lit(2026).alias("season"), F.col("c_nationkey").alias("event"), F.lit("Practice 1").alias("session"), F.col("c_custkey").alias("number"),
                   F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("team"), F.lit("x").alias("stand_in"))
    official = who.where(F.col("number") % 2 == 0).select("event", "session", "number", F.concat(F.lit("Off "), "number").alias("name"), F.lit("seven").alias("group_ref"))
    reviewed = star.spark.createDataFrame([("building", "one"), ("machinery", "two")], "team_key string, group_ref string")
    groups = star.spark.createDataFrame([("one", 1), ("two", 2), ("seven", 7)], "group_ref string, grp int")
    out, _ = Z.reviewed_groups(who, official, reviewed, groups)
    return out.select("number", "name", "grp", "source")


@query("appended_once", """SELECT o_orderkey AS event, o_orderstatus AS status FROM orders""")
def appended_once(star: Star) -> DataFrame:
    """A table that grows by the rows it does not hold yet: overlapping parts are appended, and one a second time."""
    rows = star.table("orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("status"))
    path = f"{work_folder(star.spark, 'ledger')}/rows"
    for part in (rows.where("event % 3 < 2"), rows.where("event % 3 > 0"), rows.where("event % 3 < 2")):
        record.append_new(star.spark, part, path, ["event"])
    return star.spark.read.parquet(path)


def _session_rows(star: Star) -> DataFrame:
    e = star.table("events")
    return e.select(F.year("ts").alias("season"), F.dayofyear("ts").alias("event"), F.col("event_type").alias("session"),
                    F.expr("make_dt_interval(0, 0, 0, CAST(event_id % 90000 AS DECIMAL(18, 6)) / 1000)").alias("Time"), F.col("value"), "user_id")


@query("session_weather", """
SELECT year(ts) AS season, dayofyear(ts) AS event, event_type AS session, event_id % 90000 AS time_ms, value AS "AirTemp", value > 50 AS "Rainfall" FROM events""")
def session_weather(star: Star) -> DataFrame:
    """Weather rows of sessions, their times in milliseconds."""
    out = Z.weather_table(_session_rows(star).select("season", "event", "session", "Time", F.col("value").alias("AirTemp"), (F.col("value") > 50).alias("Rainfall")))
    return out.withColumn("season", F.col("season").cast("bigint")).withColumn("event", F.col("event").cast("bigint"))


@query("session_messages", """
SELECT year(ts) AS season, dayofyear(ts) AS event, event_type AS session, CAST(user_id AS VARCHAR) AS "Message", user_id % 50 AS "Lap" FROM events""")
def session_messages(star: Star) -> DataFrame:
    rows = _session_rows(star).select("season", "event", "session", F.col("user_id").cast("string").alias("Message"), (F.col("user_id") % 50).alias("Lap"), "value")
    out = Z.messages_table(rows)
    return out.withColumn("season", F.col("season").cast("bigint")).withColumn("event", F.col("event").cast("bigint"))


@query("kept_beside", f"""
WITH {EVENTS} SELECT ev.event, season, round, 'short' AS field, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderstatus AS time FROM ev JOIN orders ON o_orderkey = event WHERE short""")
def kept_beside(star: Star) -> DataFrame:
    """A field that the schema has no column for, kept beside it where it is present."""
    o = star.table("orders").select(F.col("o_orderkey").alias("event"), F.when(F.col("o_orderstatus") == "P", F.to_date("o_orderdate").cast("string")).alias("date"), F.col("o_orderstatus").alias("time"))
    return G.sidecar(star.events().join(o, "event"), "short", "date", "time")


@query("group_points", f"""
WITH {ENTRIES} SELECT event, grp, round(sum(points) + sum(CAST(line AS DOUBLE)), 6) AS points, true AS derived FROM entries GROUP BY event, grp""")
def group_points(star: Star) -> DataFrame:
    """Points of each group in an event, from two tables of results."""
    e = _entries(star)
    out = G.group_results(e.select("event", "grp", "points"), e.select("event", "grp", F.col("line").cast("double").alias("points")))
    return out.withColumn("points", F.round("points", 6))


@query("repeated_predictions", """SELECT l_orderkey AS event, l_suppkey AS entity, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_predictions(star: Star) -> DataFrame:
    """Entities that an event's predictions name more than once."""
    return evaluate.duplicated_entities(star.table("lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("entity")))


@query("partly_filled", """
SELECT l_orderkey AS event, count(*) FILTER (WHERE l_returnflag = 'R') AS filled, count(*) AS rows FROM lineitem GROUP BY 1
HAVING count(*) FILTER (WHERE l_returnflag = 'R') NOT IN (0, count(*))""")
def partly_filled(star: Star) -> DataFrame:
    """Events where an optional column is set for some entries only."""
    rows = star.table("lineitem").select(F.col("l_orderkey").alias("event"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("extra"))
    return record.partly_filled(rows, ["event"], "extra")


@query("widened_union", """
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment, 'supplier' AS source FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment, 'customer' FROM customer""")
def widened_union(star: Star) -> DataFrame:
    """Two tables by name, each row with its source, and null where a source has no such column."""
    s = star.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = star.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return B.widen_union([("supplier", s), ("customer", c)])


@query("stand_in_identities", """
WITH a AS (SELECT c_nationkey AS number, c_name AS name, c_mktsegment AS grp, c_custkey % 7 AS event, c_custkey % 50 AS who FROM customer)
SELECT 'k' || who AS stand_in, max(name) AS name, string_agg(DISTINCT CAST(number AS VARCHAR), '|' ORDER BY CAST(number AS VARCHAR)) AS numbers,
  string_agg(DISTINCT grp, '|' ORDER BY grp) AS groups, min(CASE WHEN number % 2 = 0 AND name = 'Customer#' || lpad(CAST(number AS VARCHAR), 9, '0') THEN number END) AS entity,
  count(DISTINCT event) AS events FROM a GROUP BY who""")
def stand_in_identities(star: Star) -> DataFrame:
    """One row per stand-in: where it appeared, and the entity whose number and surname both match."""
    a = star.table("customer").select(F.concat(F.lit("k"), F.col("c_custkey") % 50).alias("stand_in"), F.lit(2026).alias("season"), (F.col("c_custkey") % 7).alias("event"), F.lit("P1").alias("session"),
                                      F.col("c_nationkey").alias("number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp"))
    n = star.table("nation").where("n_nationkey % 2 = 0")
    numbers = n.select(F.lit(2026).alias("season"), F.col("n_nationkey").alias("number"), F.col("n_nationkey").alias("entity"))
    surnames = n.select(F.col("n_nationkey").alias("entity"), F.format_string("Customer#%09d", "n_nationkey").alias("entity_surname"))
    return Z.stand_in_identities(a, numbers, surnames).select("stand_in", "name", "numbers", "groups", "entity", "events")
