"""Files in, tables out."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from cutline.sources import pages as G, sessions as Z, tables as B


def test_pages_hold_few_rows_and_still_cut_events_apart(spark):
    from cutline.plans.q_sources import paged
    from cutline.sources.star import Star

    held = spark.range(400).select(F.lit(1998).cast("bigint").alias("season"), F.floor(F.col("id") / 8).alias("event"), F.col("id").alias("entity"))
    pages, _ = paged(Star(spark, ""), held, "driverstandings", F.struct(F.col("entity").cast("string").alias("position")), rows_a_page=10)
    found = G.page_rows(pages, "driverstandings").select("round", "r.position").cache()
    G.require_complete(pages, G.page_rows(pages, "driverstandings"))
    sizes = [r[0] for r in pages.select(F.aggregate("events", F.lit(0), lambda n, e: n + F.size(e["DriverStandings"]))).collect()]
    assert sum(sizes) == 400 and max(sizes) < 60
    assert rows(found.select(F.col("position").cast("int"))) == sorted([(i,) for i in range(400)], key=repr)
    assert pages.select("request").distinct().count() == 1
    cut = pages.select(F.explode("events.round").alias("round")).groupBy("round").count().where("count > 1").count()
    assert cut > 40


def test_null_token_and_nullable_integers(spark, tmp_path):
    (tmp_path / "qualifying.csv").write_text('qualifyId,raceId,driverId,constructorId,number,position,q1,q2,q3\n'
                                             '1,18,1,1,22.0,1,"1:26.572","",\\N\n2,18,2,\\N,4,x,"a ""b"", c",1:25.0,\n')
    raw = B.read_table(spark, "qualifying", str(tmp_path)).orderBy("qualifyId").collect()
    assert (raw[0]["number"], raw[0]["q2"], raw[0]["q3"]) == (22, "", None)
    assert (raw[1]["constructorId"], raw[1]["position"], raw[1]["q1"]) == (None, None, 'a "b", c')
    assert B.read_table(spark, "qualifying", str(tmp_path), empty_is_null=True).orderBy("qualifyId").first()["q2"] is None


def test_declared_keys(spark):
    assert ("results", "raceId", "races") in B.foreign_keys() and ("results", "statusId", "status") in B.foreign_keys()
    assert len(B.SCHEMAS) == 14 and all(set(k) <= set(B.SCHEMAS[t].names) for t, k in B.PRIMARY_KEYS.items())


def test_seasons_with_different_columns(spark, tmp_path):
    (tmp_path / "2018.csv").write_text("raceId,lap\n1,5\n")
    (tmp_path / "2019.csv").write_text("raceId,lap,compound\n2,6,SOFT\n")
    df = B.read_seasons(spark, [str(tmp_path / f"{y}.csv") for y in (2018, 2019)], B.schema("raceId int, lap int"))
    assert rows(df, "raceId", "lap", "compound") == [(1, 5, None), (2, 6, "SOFT")]


def test_sink_is_sorted_and_partitioned(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3 + 2000).alias("season"), (99 - F.col("id")).alias("k"))
    B.write_table(df, str(tmp_path / "t"), ["k"], "season")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 100 and {r["season"] for r in back.select("season").distinct().collect()} == {2000, 2001, 2002}
    B.write_season(df.where("season = 2001 AND k < 10"), str(tmp_path / "t"), "season", ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).where("season <> 2001").count() == df.where("season <> 2001").count()


def lap_page(total, events):
    return {"MRData": {"total": str(total), "limit": "100", "offset": "0", "RaceTable": {"Races": events}}}


def lap(number, *drivers):
    return {"number": str(number), "Timings": [{"driverId": d, "position": "1", "time": "1:30.5"} for d in drivers]}


def test_a_lap_split_over_pages_is_whole_again(spark, tmp_path):
    base = {"season": "2024", "round": "1", "raceName": "x", "date": "2024-03-02"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps(lap_page(5, [{**base, "Laps": [lap(1, "p", "q"), lap(2, "p")]}]), indent=1))
    (tmp_path / "a" / "2.json").write_text(json.dumps(lap_page(5, [{**base, "Laps": [lap(2, "q"), lap(3, "p")]}])))
    pages = G.read_pages(spark, str(tmp_path), "laps")
    found = G.page_rows(pages, "laps")
    G.require_complete(pages, found)
    events = spark.createDataFrame([(2024, 1, 77)], "season bigint, round bigint, event bigint")
    ids = spark.createDataFrame([("p", 1), ("q", 2)], "ref string, entity bigint")
    assert rows(G.laps_table(found, events, ids), "event", "entity", "lap", "milliseconds") == [
        (77, 1, 1, 90500), (77, 1, 2, 90500), (77, 1, 3, 90500), (77, 2, 1, 90500), (77, 2, 2, 90500)]
    (tmp_path / "a" / "2.json").write_text(json.dumps(lap_page(6, [])))
    pages = G.read_pages(spark, str(tmp_path), "laps")
    with pytest.raises(ValueError, match="incomplete"):
        G.require_complete(pages, G.page_rows(pages, "laps"))


def test_results_are_typed_and_upcoming_events_left_out(spark, tmp_path):
    def row(ref, pos, text, grid, **more):
        return {"Driver": {"driverId": ref}, "Constructor": {"constructorId": "t"}, "number": "4", "position": pos, "positionText": text,
                "points": "25", "grid": grid, "laps": "57", "status": "Finished", **more}

    done = {"season": "2024", "round": "1", "Results": [
        row("p", "1", "1", "1", Time={"millis": "5504742", "time": "1:31:44.742"}, FastestLap={"rank": "1", "lap": "39", "Time": {"time": "1:32.608"}}),
        row("q", "2", "R", "0")]}
    upcoming = {"season": "2024", "round": "2", "Results": [row("p", "1", "1", "1")]}
    (tmp_path / "1.json").write_text(json.dumps(lap_page(3, [done, upcoming])))
    found = G.page_rows(G.read_pages(spark, str(tmp_path), "results"), "results")
    events = spark.createDataFrame([(2024, 1, 77)], "season bigint, round bigint, event bigint")
    ids = spark.createDataFrame([("p", 1), ("q", 2), ("t", 9)], "ref string, entity bigint")
    out = G.results_table(found, events, ids, ids)
    assert rows(out, "entity", "grp", "position", "position_text", "position_order", "milliseconds", "pit_lane_start", "fastest_lap") == [
        (1, 9, 1, "1", 1, 5504742, False, 39), (2, 9, None, "R", 2, None, True, None)]
    assert rows(G.group_results(out), "event", "grp", "points") == [(77, 9, 50.0)]


def test_sessions_get_ids_or_a_key_of_their_own(spark):
    results = spark.createDataFrame(
        [(2024, 7, "Practice 1", "4", "nor", "Lando", "Norris", "mc"), (2024, 7, "Practice 1", "50", None, "Ayumu", "Iwasa", "rb"),
         (2024, 7, "Practice 1", "16", "", "Charles", "Leclerc", "zz")],
        "season bigint, event bigint, session string, DriverNumber string, DriverId string, FirstName string, LastName string, TeamId string")
    entities = spark.createDataFrame([("nor", 1, "Norris"), ("lec", 2, "Leclerc")], "ref string, entity bigint, entity_surname string")
    numbers = spark.createDataFrame([(2024, 4, 1), (2024, 16, 2)], "season bigint, number bigint, entity bigint")
    raced = spark.createDataFrame([(7, 1)], "event bigint, entity bigint")
    who, doubts = Z.participants(results, entities, numbers, raced)
    assert rows(who, "number", "entity", "via", "is_entrant", "stand_in") == [
        ("16", 2, "number", False, None), ("4", 1, "ref", True, None), ("50", None, None, False, "2024_ayumu_iwasa")]
    assert rows(doubts, "number", "kind") == [("50", "practice participant")]
    laps = spark.sql("SELECT 2024L season, 7L event, 'Practice 1' session, '4' DriverNumber, 3 LapNumber, INTERVAL '01:31.5' MINUTE TO SECOND LapTime")
    assert rows(Z.laps_table(laps, who), "entity", "LapNumber", "LapTimeMs") == [(1, 3, 91500)]


def test_reviewed_groups(spark):
    u = spark.createDataFrame([(2026, 1, "P1", "25", None, "Cadillac", "unknown_1"), (2026, 1, "P1", "40", "A B", "Nowhere", "2026_a_b"),
                               (2026, 1, "P1", "41", "C D", "Alpha Racing", "2026_c_d")],
                              "season int, event int, session string, number string, name string, team string, stand_in string")
    official = spark.createDataFrame([(1, "P1", "25", "Colton Herta", "cad")], "event int, session string, number string, name string, group_ref string")
    reviewed = spark.createDataFrame([("alpha racing", "alp")], "team_key string, group_ref string")
    groups = spark.createDataFrame([("cad", 1), ("alp", 2)], "group_ref string, grp int")
    out, gaps = Z.reviewed_groups(u, official, reviewed, groups)
    assert rows(out, "stand_in", "grp", "source") == [
        ("2026_a_b", None, "unresolved"), ("2026_c_d", 2, "reviewed map"), ("2026_colton_herta", 1, "official classification")]
    assert rows(gaps, "number", "issue") == [("40", "team name not in the reviewed map")]
