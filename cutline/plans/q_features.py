"""Queries of the feature frame and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutline.operators import dense, runs
from cutline.plans import features as P
from cutline.plans.q_form import RELATIVE, TRAILING
from cutline.registry import ENTRIES, EVENTS, LAPS, QUALI, SESSION_LAPS, query, r6
from cutline.sources.star import ERAS, Star

STANDINGS = """
sp AS (SELECT season, round, {k}, sum(points) AS p, sum(CAST(code = '1' AS INTEGER)) AS w FROM entries WHERE {k} IS NOT NULL GROUP BY ALL),
sg AS (SELECT * FROM (SELECT DISTINCT season, {k} FROM sp) JOIN (SELECT DISTINCT season, round FROM ev) USING (season)),
sc AS (SELECT season, round, {k}, sum(coalesce(p, 0)) OVER c AS standing_points, sum(coalesce(w, 0)) OVER c AS wins
  FROM sg LEFT JOIN sp USING (season, round, {k}) WINDOW c AS (PARTITION BY season, {k} ORDER BY round ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, rank() OVER (PARTITION BY season, round ORDER BY standing_points DESC) AS standing_position FROM sc)"""


def standings_sql(key: str, prefix: str) -> str:
    import re

    return re.sub(r"\b(sp|sg|sc|st)\b", lambda m: f"{prefix}_{m[0]}", STANDINGS.format(k=key))


PREVIOUS_ROUND = "pr AS (SELECT season, round, lag(round) OVER (PARTITION BY season ORDER BY round) AS previous_round FROM (SELECT DISTINCT season, round FROM ev))"


@query("dense_cumulative", f"""
WITH {ENTRIES}, {standings_sql("entity", "e")}
SELECT season, round, entity, round(standing_points, 6) AS standing_points, CAST(wins AS BIGINT) AS wins, standing_position FROM e_st
""")
def dense_cumulative(star: Star) -> DataFrame:
    out = dense.standings(star.entries(), star.events(), "entity", star.planner(times=12))
    return out.select("season", "round", "entity", r6("standing_points", "standing_points"),
                      F.col("wins").cast("bigint").alias("wins"), "standing_position")


@query("standing_before", f"""
WITH {ENTRIES}, {standings_sql("entity", "e")}, {PREVIOUS_ROUND}
SELECT e.event, e.entity, s.standing_position, round(s.standing_points, 6) AS standing_points
FROM entries e LEFT JOIN pr USING (season, round)
LEFT JOIN e_st s ON s.season = e.season AND s.round = pr.previous_round AND s.entity = e.entity
""")
def standing_before(star: Star) -> DataFrame:
    entries = star.entries()
    table = dense.standings(entries, star.events(), "entity", star.planner(times=12))
    out = dense.standing_before(entries.select("event", "entity", "season", "round"), table, star.events(), "entity")
    return out.select("event", "entity", "standing_position", r6("standing_points", "standing_points"))


PREVIOUS = """
held AS (SELECT ord, event AS previous FROM ev WHERE event IN (SELECT event FROM entries)),
prev AS (SELECT ev.event, h.previous FROM ev ASOF LEFT JOIN held h ON ev.ord > h.ord)"""


@query("field_pre_weekend", f"""
WITH {ENTRIES}, {PREVIOUS}
SELECT p.event, e.entity, e.grp FROM prev p JOIN entries e ON e.event = p.previous WHERE e.code <> 'W'
""")
def field_pre_weekend(star: Star) -> DataFrame:
    return P.resolve_field(star.feature_tables(), P.PRE)


COMPOUND_FROM = 1998
PRACTICE_FIELD = """
ran AS (SELECT l.event, l.entity, max(l.session) > 1 AS later FROM laps l JOIN ev USING (event) WHERE NOT short OR session = 1 GROUP BY ALL),
took AS (SELECT event, entity FROM ran QUALIFY later OR NOT bool_or(later) OVER (PARTITION BY event)),
starts AS (SELECT entity, ord, grp FROM entries WHERE code <> 'W')"""


@query("field_post_practice", f"""
WITH {ENTRIES}, {LAPS}, {PRACTICE_FIELD}
SELECT t.event, t.entity, r.grp FROM (SELECT * FROM took JOIN ev USING (event)) t ASOF LEFT JOIN starts r ON r.entity = t.entity AND t.ord > r.ord
""")
def field_post_practice(star: Star) -> DataFrame:
    return P.resolve_field(star.feature_tables(), P.PRACTICE)


def practice_sql(source: str, min_laps: int) -> str:
    return f"""
clean AS (SELECT * FROM {source} WHERE accurate AND green AND lap_ms IS NOT NULL),
lr AS (SELECT * FROM clean QUALIFY count(*) OVER (PARTITION BY event, entity, session, stint) >= {min_laps}),
pace AS (SELECT event, entity, median(lap_ms) AS pace, count(*) AS n FROM lr GROUP BY ALL),
dry AS (SELECT *, CASE compound WHEN 'SOFT' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS rnk FROM clean WHERE compound IN ('SOFT', 'MEDIUM', 'HARD')),
comp AS (SELECT event, entity, count(DISTINCT rnk) AS n FROM dry GROUP BY ALL),
ons AS (SELECT * FROM dry QUALIFY rnk = min(rnk) OVER (PARTITION BY event, entity)),
softlr AS (SELECT * FROM ons QUALIFY count(*) OVER (PARTITION BY event, entity, session, stint) >= {min_laps}),
soft AS (SELECT event, entity, median(lap_ms) AS pace FROM softlr GROUP BY ALL),
best AS (SELECT event, entity, min(lap_ms) AS b FROM clean GROUP BY ALL),
prac AS (SELECT a.event, a.entity, a.n AS practice_laps, b.b - min(b.b) OVER w AS practice_best_gap_ms,
  pace.pace - min(pace.pace) OVER w AS practice_long_run_gap_ms, coalesce(pace.n, 0) AS practice_long_run_laps,
  comp.n AS practice_compounds, soft.pace - min(soft.pace) OVER w AS practice_softest_long_run_gap_ms
  FROM (SELECT event, entity, count(*) AS n FROM {source} GROUP BY ALL) a LEFT JOIN best b USING (event, entity)
  LEFT JOIN pace USING (event, entity) LEFT JOIN comp USING (event, entity) LEFT JOIN soft USING (event, entity)
  WINDOW w AS (PARTITION BY a.event))"""


@query("long_runs", f"""
WITH {SESSION_LAPS}, {practice_sql("slaps", 5)}
SELECT event, entity, practice_laps, practice_best_gap_ms, practice_long_run_gap_ms, practice_long_run_laps,
  practice_compounds, practice_softest_long_run_gap_ms FROM prac
""")
def long_runs(star: Star) -> DataFrame:
    return runs.practice_frame(star.session_laps(), star.planner("events"))


ERA_SQL = ", ".join(f"({a}, {b if b else 'NULL'}, '{k}')" for a, b, k in ERAS)
CONTEXT = f"""
eras AS (SELECT * FROM (VALUES {ERA_SQL}) v(f, l, era)),
seasons AS (SELECT s.season, era FROM (SELECT DISTINCT season FROM ev) s LEFT JOIN eras ON s.season >= f AND (l IS NULL OR s.season <= l)),
into_era AS (SELECT season, season - min(season) OVER (PARTITION BY era) AS seasons_into_era FROM seasons)"""


@query("era_context", f"""
WITH {EVENTS}, {CONTEXT} SELECT event, round AS round_index, seasons_into_era FROM ev LEFT JOIN into_era USING (season)
""")
def era_context(star: Star) -> DataFrame:
    return P.season_context(star.feature_tables())


def frame_sql(snapshot: str) -> str:
    """The feature frame as one SELECT, from the same parts as the single queries."""
    if snapshot == P.POST:
        fieldsrc = f"""{PREVIOUS}, field AS (SELECT e.event, e.entity, e.grp FROM quali q JOIN entries e USING (event, entity)
  UNION ALL SELECT p.event, e.entity, e.grp FROM prev p JOIN entries e ON e.event = p.previous
  WHERE e.code <> 'W' AND p.event NOT IN (SELECT event FROM quali))"""
    elif snapshot == P.PRACTICE:
        fieldsrc = f"""{LAPS}, {PRACTICE_FIELD}, field AS (SELECT t.event, t.entity, r.grp FROM (SELECT * FROM took JOIN ev USING (event)) t ASOF LEFT JOIN starts r ON r.entity = t.entity AND t.ord > r.ord),
plaps AS (SELECT l.* FROM laps l JOIN ev USING (event) JOIN field USING (event, entity) WHERE (NOT short OR session = 1) AND event % 10 <> 0)"""
    else:
        fieldsrc = f"{PREVIOUS}, field AS (SELECT p.event, e.entity, e.grp FROM prev p JOIN entries e ON e.event = p.previous WHERE e.code <> 'W')"
    weekend_ctes = {P.POST: f", {LAPS}, {practice_sql('laps', 5)}", P.PRACTICE: f", {practice_sql('plaps', 5)}"}.get(snapshot, "")
    weekend = """,
  coalesce(practice_laps, 0) AS practice_laps, practice_best_gap_ms, practice_long_run_gap_ms, coalesce(practice_long_run_laps, 0) AS practice_long_run_laps, practice_compounds, practice_softest_long_run_gap_ms,
  qq.position AS quali_position, qq.best - min(qq.best) OVER (PARTITION BY f.event) AS quali_gap_to_best_ms,
  qq.best - (SELECT min(o.best) FROM qg o WHERE o.event = f.event AND o.grp = f.grp AND o.entity <> f.entity) AS quali_mate_gap_ms,
  CASE WHEN qq.event IS NOT NULL THEN CAST(qq.q3 IS NOT NULL AS INTEGER) END AS quali_reached_last""" if snapshot == P.POST else ""
    weekend_join = "LEFT JOIN prac USING (event, entity) LEFT JOIN qg qq USING (event, entity)" if snapshot == P.POST else ""
    if snapshot == P.PRACTICE:
        weekend, weekend_join = f""",
  coalesce(practice_laps, 0) AS practice_laps, practice_best_gap_ms, practice_long_run_gap_ms, coalesce(practice_long_run_laps, 0) AS practice_long_run_laps,
  CASE WHEN f.season >= {COMPOUND_FROM} THEN practice_compounds END AS practice_compounds,
  CASE WHEN f.season >= {COMPOUND_FROM} THEN practice_softest_long_run_gap_ms END AS practice_softest_long_run_gap_ms""", "LEFT JOIN prac ON prac.event = f.event AND prac.entity = f.entity"
    names = P.features_for(snapshot)
    outer = ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)
    return f"""
WITH {ENTRIES}, {QUALI}, {fieldsrc}, {CONTEXT},
f0 AS (SELECT field.*, ev.ord, ev.season, ev.round, ev.venue FROM field JOIN ev USING (event)),
es AS (SELECT entity, ord, {TRAILING} FROM entries WINDOW s AS (PARTITION BY entity ORDER BY ord ROWS 4 PRECEDING),
  l AS (PARTITION BY entity ORDER BY ord ROWS 9 PRECEDING), a AS (PARTITION BY entity ORDER BY ord ROWS UNBOUNDED PRECEDING)),
gs0 AS (SELECT grp, ord, finish, entity, {TRAILING} FROM entries WINDOW s AS (PARTITION BY grp ORDER BY ord, finish, entity ROWS 4 PRECEDING),
  l AS (PARTITION BY grp ORDER BY ord, finish, entity ROWS 9 PRECEDING), a AS (PARTITION BY grp ORDER BY ord, finish, entity ROWS UNBOUNDED PRECEDING)),
gs AS (SELECT * FROM gs0 QUALIFY row_number() OVER (PARTITION BY grp, ord ORDER BY finish DESC, entity DESC) = 1),
{RELATIVE},
tm AS (SELECT grp, ord, avg(finish) AS y FROM entries WHERE NOT retired GROUP BY ALL),
tn AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS x FROM tm),
tr AS (SELECT grp, ord, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(y, x) OVER w END AS trend FROM tn WINDOW w AS (PARTITION BY grp ORDER BY ord ROWS 4 PRECEDING)),
qg AS (SELECT x.*, e.grp, e.ord, least(q1, q2, q3) AS best FROM quali x JOIN entries e USING (event, entity)),
own AS (SELECT entity, ord, avg(position) OVER (PARTITION BY entity ORDER BY ord ROWS 2 PRECEDING) AS own3 FROM qg),
gb AS (SELECT grp, ord, min(position) AS pos FROM qg GROUP BY ALL),
team AS (SELECT grp, ord, avg(pos) OVER (PARTITION BY grp ORDER BY ord ROWS 2 PRECEDING) AS team3 FROM gb),
raced AS (SELECT entity, ord, grp AS last_grp FROM entries WHERE code <> 'W'),
ev_state AS (SELECT entity, venue, ord, count(*) OVER w AS n, avg(CASE WHEN NOT retired THEN finish END) OVER w AS m FROM entries
  WINDOW w AS (PARTITION BY entity, venue ORDER BY ord ROWS UNBOUNDED PRECEDING)),
gv0 AS (SELECT grp, venue, ord, count(*) AS n, sum(CASE WHEN NOT retired THEN finish END) AS s, count(CASE WHEN NOT retired THEN 1 END) AS c FROM entries WHERE grp IS NOT NULL GROUP BY ALL),
gv AS (SELECT grp, venue, ord, sum(n) OVER w AS n, sum(s) OVER w / nullif(sum(c) OVER w, 0) AS m FROM gv0 WINDOW w AS (PARTITION BY grp, venue ORDER BY ord ROWS UNBOUNDED PRECEDING)),
pe AS (SELECT event, sum(CASE WHEN grid > 0 THEN abs(grid - finish) END) AS m, count(CASE WHEN grid > 0 THEN 1 END) AS k,
  sum(CAST(retired AS INTEGER)) AS o, count(*) AS r FROM entries GROUP BY event),
vh AS (SELECT ev.event, count(pe.event) OVER w AS n, sum(m) OVER w / nullif(sum(k) OVER w, 0) AS ch, sum(o) OVER w / nullif(sum(r) OVER w, 0) AS dn
  FROM ev LEFT JOIN pe USING (event) WINDOW w AS (PARTITION BY venue ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{standings_sql("entity", "e")}, {standings_sql("grp", "g")}, {PREVIOUS_ROUND}{weekend_ctes},
f1 AS (SELECT f0.*, es.finish_mean AS entity_finish_mean_5, es.points_rate AS entity_points_rate_5, es.dnf_rate AS entity_dnf_rate_10, coalesce(es.seen, 0) AS entity_events_started
  FROM f0 ASOF LEFT JOIN es ON f0.entity = es.entity AND f0.ord > es.ord),
f2 AS (SELECT f1.*, mate_gap AS entity_vs_mate_finish_mean_5 FROM f1 ASOF LEFT JOIN rel ON f1.entity = rel.entity AND f1.ord > rel.ord),
f3 AS (SELECT f2.*, points_share AS entity_points_share_5 FROM f2 ASOF LEFT JOIN sh ON f2.entity = sh.entity AND f2.ord > sh.ord),
f4 AS (SELECT f3.*, own3 AS entity_quali_mean_3 FROM f3 ASOF LEFT JOIN own ON f3.entity = own.entity AND f3.ord > own.ord),
f5 AS (SELECT f4.*, last_grp FROM f4 ASOF LEFT JOIN raced ON f4.entity = raced.entity AND f4.ord > raced.ord),
f6 AS (SELECT f5.*, team3 AS group_quali_mean_3 FROM f5 ASOF LEFT JOIN team ON f5.last_grp = team.grp AND f5.ord > team.ord),
f7 AS (SELECT f6.*, gs.finish_mean AS group_finish_mean_5, gs.points_rate AS group_points_rate_5, gs.dnf_rate AS group_dnf_rate_10
  FROM f6 ASOF LEFT JOIN gs ON f6.grp = gs.grp AND f6.ord > gs.ord),
f8 AS (SELECT f7.*, tr.trend AS group_finish_trend_5 FROM f7 ASOF LEFT JOIN tr ON f7.grp = tr.grp AND f7.ord > tr.ord),
f9 AS (SELECT f8.*, coalesce(v.n, 0) AS entity_venue_events, v.m AS entity_venue_finish_mean FROM f8 ASOF LEFT JOIN ev_state v ON f8.entity = v.entity AND f8.venue = v.venue AND f8.ord > v.ord),
f10 AS (SELECT f9.*, coalesce(v.n, 0) AS group_venue_events, v.m AS group_venue_finish_mean FROM f9 ASOF LEFT JOIN gv v ON f9.grp = v.grp AND f9.venue = v.venue AND f9.ord > v.ord),
f11 AS (SELECT f.*, pr.previous_round, e_st.standing_position AS entity_standing_position, e_st.standing_points AS entity_standing_points,
  g_st.standing_position AS group_standing_position, g_st.standing_points AS group_standing_points,
  vh.n AS venue_prior_events, vh.ch AS venue_position_change, vh.dn AS venue_dnf_rate, f.round AS round_index, seasons_into_era{weekend}
  FROM f10 f LEFT JOIN pr USING (season, round) LEFT JOIN e_st ON e_st.season = f.season AND e_st.round = pr.previous_round AND e_st.entity = f.entity
  LEFT JOIN g_st ON g_st.season = f.season AND g_st.round = pr.previous_round AND g_st.grp = f.grp
  LEFT JOIN vh ON vh.event = f.event LEFT JOIN into_era i ON i.season = f.season {weekend_join.replace("USING (event, entity) LEFT JOIN", "ON prac.event = f.event AND prac.entity = f.entity LEFT JOIN").replace("qg qq USING (event, entity)", "qg qq ON qq.event = f.event AND qq.entity = f.entity")})
SELECT event, entity, '{snapshot}' AS snapshot, {outer} FROM f11
"""


def rounded(df: DataFrame, snapshot: str) -> DataFrame:
    return df.select(*P.KEYS, *[r6(n, n) for n in P.features_for(snapshot)])


@query("feature_frame", frame_sql(P.POST))
def feature_frame(star: Star) -> DataFrame:
    return rounded(P.build(star.feature_tables(), P.POST), P.POST)


@query("feature_frame_pre_weekend", frame_sql(P.PRE))
def feature_frame_pre_weekend(star: Star) -> DataFrame:
    return rounded(P.build(star.feature_tables(), P.PRE), P.PRE)


@query("feature_frame_post_practice", frame_sql(P.PRACTICE))
def feature_frame_post_practice(star: Star) -> DataFrame:
    """The frame after practice; every tenth event's laps are unusable, and compounds are known from one season on."""
    from dataclasses import replace

    t = star.feature_tables()
    t = replace(t, first_compound_season=COMPOUND_FROM, unusable_laps=t.events.where("event % 10 = 0"))
    return rounded(P.build(t, P.PRACTICE), P.PRACTICE)


@query("training_frame", f"""
WITH {ENTRIES}
SELECT event, entity, finish AS finish_order, CAST(code = '1' AS INTEGER) AS win, CAST(finish <= 3 AND NOT retired AS INTEGER) AS podium,
  CAST(finish <= 10 AND NOT retired AS INTEGER) AS top10, CAST(retired AS INTEGER) AS dnf FROM entries WHERE code <> 'W'
""")
def training_frame(star: Star) -> DataFrame:
    entries = star.entries()
    return P.training_frame(entries.select("event", "entity"), entries).select(
        "event", "entity", "finish_order", "win", "podium", "top10", "dnf")
