"""Queries of the window and peer operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutline.functions import scalars as S
from cutline.operators import form, peers
from cutline.operators.spans import expanding, numbered, trailing
from cutline.registry import ENTRIES, EVENTS, LAPS, QUALI, RAW, query, r6
from cutline.session import stored
from cutline.sources.star import Star


FIELD = ("event", "entity", "grp", "ord")

TRAILING = """
  avg(CASE WHEN NOT retired THEN finish END) OVER s AS finish_mean, avg(points) OVER s AS points_rate,
  avg(CAST(retired AS INTEGER)) OVER l AS dnf_rate, count(*) OVER a AS seen"""
FORM_OUT = """round(finish_mean, 6) AS finish_mean, round(points_rate, 6) AS points_rate,
  round(dnf_rate, 6) AS dnf_rate, CAST(coalesce(seen, 0) AS BIGINT) AS seen"""


def form_out(df: DataFrame) -> DataFrame:
    return df.select("event", "entity", r6("finish_mean", "finish_mean"), r6("points_rate", "points_rate"),
                     r6("dnf_rate", "dnf_rate"), F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen"))


@query("trailing_form", f"""
WITH {ENTRIES}, state AS (SELECT entity, ord, {TRAILING} FROM entries WINDOW
  s AS (PARTITION BY entity ORDER BY ord ROWS 4 PRECEDING), l AS (PARTITION BY entity ORDER BY ord ROWS 9 PRECEDING),
  a AS (PARTITION BY entity ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT f.event, f.entity, {FORM_OUT} FROM entries f ASOF LEFT JOIN state t ON f.entity = t.entity AND f.ord > t.ord
""")
def trailing_form(star: Star) -> DataFrame:
    entries = stored(star.entries(), "entries")
    return form_out(form.trailing_form(entries.select(*FIELD), entries, "entity", star.planner()))


@query("trailing_group_form", f"""
WITH {ENTRIES}, state AS (SELECT grp, ord, finish, entity, {TRAILING} FROM entries WINDOW
  s AS (PARTITION BY grp ORDER BY ord, finish, entity ROWS 4 PRECEDING),
  l AS (PARTITION BY grp ORDER BY ord, finish, entity ROWS 9 PRECEDING),
  a AS (PARTITION BY grp ORDER BY ord, finish, entity ROWS UNBOUNDED PRECEDING)),
last_of AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY grp, ord ORDER BY finish DESC, entity DESC) = 1)
SELECT f.event, f.entity, {FORM_OUT} FROM entries f ASOF LEFT JOIN last_of t ON f.grp = t.grp AND f.ord > t.ord
""")
def trailing_group_form(star: Star) -> DataFrame:
    entries = stored(star.entries(), "entries")
    return form_out(form.trailing_form(entries.select(*FIELD), entries, "grp", star.planner()))


LAST3 = f"""
WITH {ENTRIES}, {QUALI},
q AS (SELECT x.event, x.entity, x.position, e.ord, e.grp, e.code FROM quali x JOIN entries e USING (event, entity)),
own AS (SELECT entity, ord, avg(position) OVER (PARTITION BY entity ORDER BY ord ROWS 2 PRECEDING) AS own3 FROM q),
best AS (SELECT grp, ord, min(position) AS pos FROM q GROUP BY ALL),
team AS (SELECT grp, ord, avg(pos) OVER (PARTITION BY grp ORDER BY ord ROWS 2 PRECEDING) AS team3 FROM best),
last_grp AS (SELECT entity, ord, grp FROM entries WHERE code <> 'W'),
f AS (SELECT e.event, e.entity, e.ord, g.grp AS team FROM entries e ASOF LEFT JOIN last_grp g ON e.entity = g.entity AND e.ord > g.ord),
f2 AS (SELECT f.*, own3 FROM f ASOF LEFT JOIN own o ON f.entity = o.entity AND f.ord > o.ord)
SELECT event, entity, round(own3, 6) AS own_mean_3, round(team3, 6) AS group_mean_3
FROM f2 ASOF LEFT JOIN team t ON f2.team = t.grp AND f2.ord > t.ord
"""


@query("last3_means", LAST3)
def last3_means(star: Star) -> DataFrame:
    from cutline.plans.features import recent_qualifying

    entries = stored(star.keep_raw().entries(), "entries")
    out = recent_qualifying(entries.select("event", "entity", "ord"), entries, star.qualifying(), star.planner())
    return out.select("event", "entity", r6("own_mean_3", "own_mean_3"), r6("group_mean_3", "group_mean_3"))


@query("trailing_slope", f"""
WITH {ENTRIES}, m AS (SELECT grp, ord, avg(finish) AS y FROM entries WHERE NOT retired GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS x FROM m)
SELECT grp, ord, round(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(y, x) OVER w END, 6) AS trend FROM n
WINDOW w AS (PARTITION BY grp ORDER BY ord ROWS 4 PRECEDING)
""")
def trailing_slope(star: Star) -> DataFrame:
    return form.trailing_trend(star.entries(), "grp", star.planner()).select("grp", "ord", r6("trend", "trend"))


@query("venue_history", f"""
WITH {ENTRIES}, pe AS (SELECT event, sum(CASE WHEN grid > 0 THEN abs(grid - finish) END) AS m,
  count(CASE WHEN grid > 0 THEN 1 END) AS k, sum(CAST(retired AS INTEGER)) AS o, count(*) AS r FROM entries GROUP BY event),
c AS (SELECT ev.event, count(pe.event) OVER w AS n, sum(m) OVER w AS m, sum(k) OVER w AS k, sum(o) OVER w AS o, sum(r) OVER w AS r
  FROM ev LEFT JOIN pe USING (event)
  WINDOW w AS (PARTITION BY venue ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event, n AS prior_events, round(CASE WHEN k > 0 THEN m / k END, 6) AS position_change,
  round(CASE WHEN r > 0 THEN o / r END, 6) AS venue_dnf_rate FROM c
""")
def venue_history(star: Star) -> DataFrame:
    out = form.venue_history(star.entries(), star.events(), star.planner("orders"))
    return out.select("event", "prior_events", r6("position_change", "position_change"),
                      r6("venue_dnf_rate", "venue_dnf_rate"))


@query("entity_venue_history", f"""
WITH {ENTRIES}
SELECT event, entity, count(*) OVER w AS venue_entries,
  round(avg(CASE WHEN NOT retired THEN finish END) OVER w, 6) AS venue_finish_mean FROM entries
WINDOW w AS (PARTITION BY entity, venue ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def entity_venue_history(star: Star) -> DataFrame:
    entries = star.entries()
    finish = F.when(~F.col("retired"), F.col("finish"))
    out = expanding(entries, star.spans(entries, ["entity", "venue"], "ord"), {
        "venue_entries": ("sum", F.lit(1)), "_s": ("sum", finish), "_n": ("sum", finish.isNotNull().cast("int"))})
    return out.select("event", "entity", F.col("venue_entries").cast("bigint").alias("venue_entries"),
                      r6(F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")), "venue_finish_mean"))


@query("season_to_date", f"""
WITH {ENTRIES}
SELECT event, entity, round(coalesce(sum(points) OVER w, 0), 6) AS points_before, count(*) OVER w AS events_before,
  coalesce(CAST(sum(CAST(code = '1' AS INTEGER)) OVER w AS BIGINT), 0) AS wins_before
FROM entries WINDOW w AS (PARTITION BY season, entity ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def season_to_date(star: Star) -> DataFrame:
    entries = star.entries()
    out = expanding(entries, star.spans(entries, ["season", "entity"], "ord"), {
        "points_before": ("sum", F.col("points")), "events_before": ("sum", F.lit(1)),
        "wins_before": ("sum", (F.col("code") == "1").cast("int"))})
    return out.select("event", "entity", r6("points_before", "points_before"),
                      F.col("events_before").cast("bigint").alias("events_before"),
                      F.col("wins_before").cast("bigint").alias("wins_before"))


@query("leave_one_out", f"""
WITH {ENTRIES}
SELECT event, entity, round((sum(finish) OVER w - finish) / (count(*) OVER w - 1), 6) AS mate_mean
FROM entries WHERE NOT retired AND grp IS NOT NULL
WINDOW w AS (PARTITION BY event, grp) QUALIFY count(*) OVER w > 1
""")
def leave_one_out(star: Star) -> DataFrame:
    finished = star.entries().where("NOT retired").select("event", "entity", "grp", "finish")
    return form.peer_means(finished, ["event", "grp"], "finish", star.planner()).select("event", "entity", r6("mate_mean", "mate_mean"))


RELATIVE = """
fin AS (SELECT *, count(*) OVER g AS n, sum(finish) OVER g AS t FROM entries WHERE NOT retired AND grp IS NOT NULL WINDOW g AS (PARTITION BY event, grp)),
pairs AS (SELECT entity, ord, finish - (t - finish) / (n - 1) AS gap FROM fin WHERE n > 1),
rel AS (SELECT entity, ord, avg(gap) OVER (PARTITION BY entity ORDER BY ord ROWS 4 PRECEDING) AS mate_gap FROM pairs),
pt AS (SELECT entity, ord, points, sum(points) OVER (PARTITION BY event, grp) AS team FROM entries),
sh AS (SELECT entity, ord, CASE WHEN sum(team) OVER w > 0 THEN sum(points) OVER w / sum(team) OVER w END AS points_share
  FROM pt WINDOW w AS (PARTITION BY entity ORDER BY ord ROWS 4 PRECEDING))"""


@query("relative_form", f"""
WITH {ENTRIES}, {RELATIVE},
a AS (SELECT f.event, f.entity, f.ord, mate_gap FROM entries f ASOF LEFT JOIN rel r ON f.entity = r.entity AND f.ord > r.ord)
SELECT a.event, a.entity, round(mate_gap, 6) AS mate_gap, round(points_share, 6) AS points_share
FROM a ASOF LEFT JOIN sh ON a.entity = sh.entity AND a.ord > sh.ord
""")
def relative_form(star: Star) -> DataFrame:
    entries = star.entries()
    plan = star.planner()
    against, shares = form.relative_form(entries, plan)
    field = entries.select("event", "entity", "ord")
    out = form.as_of(form.as_of(field, against, "entity", ["mate_gap"], plan), shares, "entity", ["points_share"], plan)
    return out.select("event", "entity", r6("mate_gap", "mate_gap"), r6("points_share", "points_share"))


@query("qualifying_gaps", f"""
WITH {ENTRIES}, {QUALI}, t AS (SELECT x.*, e.grp, least(q1, q2, q3) AS best FROM quali x JOIN entries e USING (event, entity))
SELECT a.event, a.entity, a.position AS quali_position, CAST(a.best - min(a.best) OVER (PARTITION BY a.event) AS BIGINT) AS gap_to_best,
  CAST(a.best - (SELECT min(b.best) FROM t b WHERE b.event = a.event AND b.grp = a.grp AND b.entity <> a.entity) AS BIGINT) AS gap_to_mate,
  CAST(a.q3 IS NOT NULL AS INTEGER) AS reached_last FROM t a
""")
def qualifying_gaps(star: Star) -> DataFrame:
    from cutline.plans.features import qualifying_frame

    groups = star.table("supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("bigint").alias("grp"))
    return qualifying_frame(star.qualifying().join(groups, "entity"), star.planner()).select(
        "event", "entity", "quali_position", "gap_to_best", "gap_to_mate", "reached_last")


@query("median_ratio_flag", f"""
WITH {LAPS}, m AS (SELECT event, median(lap_ms) AS med FROM laps GROUP BY event)
SELECT event, count(*) AS laps, CAST(sum(CAST(lap_ms >= 3.0 * med AS INTEGER)) AS BIGINT) AS flagged, any_value(med) AS median_ms
FROM laps JOIN m USING (event) GROUP BY event
""")
def median_ratio_flag(star: Star) -> DataFrame:
    flagged = peers.ratio_flag(star.laps(), ["event"], "lap_ms", 3.0, "suspended", star.planner(times=9), "median_ms")
    return flagged.groupBy("event").agg(F.count("*").alias("laps"), F.sum(F.col("suspended").cast("bigint")).alias("flagged"), F.max("median_ms").alias("median_ms"))


@query("exact_median_by_venue", f"""
WITH {EVENTS}, {LAPS} SELECT venue, median(lap_ms) AS median_ms, count(*) AS laps FROM laps JOIN ev USING (event) GROUP BY venue
""")
def exact_median_by_venue(star: Star) -> DataFrame:
    laps = star.laps().join(star.events().select("event", "venue"), "event")
    return peers.exact_median(laps, ["venue"], "lap_ms", star.planner(times=9), "median_ms").join(
        laps.groupBy("venue").agg(F.count("*").alias("laps")), "venue")


PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query("lap_percentiles", f"""
WITH {EVENTS}, {LAPS}, g AS (SELECT venue, quantile_cont(lap_ms, {list(PERCENTILES)}) AS v FROM laps JOIN ev USING (event) GROUP BY venue)
SELECT venue, CAST(unnest({list(PERCENTILES)}) AS DOUBLE) AS q, round(unnest(v), 6) AS lap_ms FROM g""")
def lap_percentiles(star: Star) -> DataFrame:
    """Percentiles of lap times by venue."""
    laps = star.laps().join(star.events().select("event", "venue"), "event")
    return peers.exact_quantiles(laps, ["venue"], "lap_ms", PERCENTILES, star.planner(times=9)).select("venue", "q", r6("quantile", "lap_ms"))


@query("running_number", f"""
WITH {ENTRIES}
SELECT event, entity, CASE WHEN NOT retired THEN count(*) FILTER (WHERE NOT retired)
  OVER (PARTITION BY entity ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS official_number FROM entries
""")
def running_number(star: Star) -> DataFrame:
    entries = star.entries()
    out = peers.running_number(entries, star.spans(entries, ["entity"], "ord"), ~F.col("retired"), "official_number",
                               [F.col("event")])
    return out.select("event", "entity", "official_number")


@query("cumulative_rank_lag", f"""
WITH {ENTRIES}, {QUALI}
SELECT e.event, e.entity, round(sum(points) OVER (PARTITION BY season, entity ORDER BY ord ROWS UNBOUNDED PRECEDING), 6) AS running_points,
  rank() OVER (PARTITION BY e.event ORDER BY points) AS points_rank,
  lag(finish) OVER (PARTITION BY e.entity ORDER BY ord) AS previous_finish FROM entries e
""")
def cumulative_rank_lag(star: Star) -> DataFrame:
    entries = star.entries().select("event", "entity", "season", "ord", "points", "finish")
    running = expanding(entries, star.spans(entries, ["season", "entity"], "ord"),
                        {"running_points": ("sum", F.col("points"))}, inclusive=True)
    ranked = numbered(running, star.spans(running, ["event"], "points"), "points_rank", kind="rank")
    lagged = trailing(ranked, star.spans(ranked, ["entity"], "ord"), 1, lambda w: {"previous_finish": F.lag("finish").over(w)})
    return lagged.select("event", "entity", r6("running_points", "running_points"), "points_rank", "previous_finish")


@query("first_last_per_key", f"""
WITH {ENTRIES}
SELECT entity, season, arg_min(event, ord) AS first_event, arg_max(event, ord) AS last_event,
  arg_max(finish, ord) AS last_finish FROM entries GROUP BY ALL
""")
def first_last_per_key(star: Star) -> DataFrame:
    return star.entries().groupBy("entity", "season").agg(
        F.min_by("event", "ord").alias("first_event"), F.max_by("event", "ord").alias("last_event"),
        F.max_by("finish", "ord").alias("last_finish"))


@query("group_pairs", f"""
WITH {ENTRIES}
SELECT event, grp, min(entity) AS entity_a, max(entity) AS entity_b, arg_min(finish, entity) AS finish_a,
  arg_max(finish, entity) AS finish_b FROM entries WHERE grp IS NOT NULL GROUP BY event, grp HAVING count(*) = 2
""")
def group_pairs(star: Star) -> DataFrame:
    return peers.pairs_of_two(star.entries(), ["event", "grp"], "entity", ["finish"])


@query("duration_ms", f"""
WITH {RAW}, {QUALI}
SELECT event, entity, CAST(q1 AS BIGINT) AS q1_ms, CAST(q2 AS BIGINT) AS q2_ms, CAST(least(q1, q2, q3) AS BIGINT) AS best_ms,
  -CAST(q1 AS BIGINT) AS negative_ms, CAST(NULL AS BIGINT) AS unparseable_ms, true AS gap_is_gap FROM quali
""")
def duration_ms(star: Star) -> DataFrame:
    q = star.qualifying()
    times = [S.duration_ms(F.col(c)) for c in ("q1", "q2", "q3")]
    return q.select("event", "entity", times[0].alias("q1_ms"), times[1].alias("q2_ms"), S.best_of(*times).alias("best_ms"),
                    S.duration_ms(F.concat(F.lit("-"), "q1")).alias("negative_ms"),
                    S.duration_ms(F.concat(F.col("q1"), F.lit("x"))).alias("unparseable_ms"),
                    S.is_gap(F.concat(F.lit(" +"), "q1")).alias("gap_is_gap"))
