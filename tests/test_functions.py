"""Scalars, text, the uniform: hand values."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from cutline.functions import scalars as S, text as X
from cutline.functions.chance import poisson_one, uniform


@pytest.mark.parametrize("text, ms", [
    ("38.109", 38109), ("1:38.109", 98109), ("1:42:06.304", 6126304), ("+5.478", 5478), ("-1:00.5", -60500), ("25.1", 25100),
    (" 1:02.03 ", 62030), ("", None), (None, None), ("\\N", None), ("1 Lap", None), ("1:2:3:4.5", None), ("12", None)])
def test_duration(spark, text, ms):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.duration_ms(F.col("t"))).first()[0] == ms


def test_positions_and_targets(spark):
    df = spark.createDataFrame([("15", "R", 15), ("1", "1", 1), (None, None, None), ("4", "4", 4)], "p string, t string, f int")
    place = df.select(*[c.alias(n) for n, c in S.encode_position(F.col("p"), F.col("t")).items()])
    assert rows(place) == sorted([(None, "R", 15), (1, "1", 1), (None, "", None), (4, "4", 4)], key=repr)
    hits = df.select(*S.targets(F.col("f"), F.col("t")).values())
    assert rows(hits) == sorted([(0, 0, 0, 1), (1, 1, 1, 0), (0, 0, 0, 0), (0, 0, 1, 0)], key=repr)


def test_names(spark):
    df = spark.createDataFrame([("Pérez", "perez"), ("HÜLKENBERG", "hulkenberg"), (" Räikkönen ", "raikkonen"), ("Çağla", "cagla")], "a string, b string")
    assert all(r[0] for r in df.select(S.name_key(F.col("a")) == F.col("b")).collect())
    assert all(r[0] for r in df.select(S.same_name(F.col("a"), F.col("b"))).collect())
    assert df.select(S.slug(F.lit("São Paulo Grand Prix!"))).first()[0] == "sao-paulo-grand-prix"


def test_stand_in_keys(spark):
    df = spark.createDataFrame([("Ayumu Iwasa",), ("nan",), (None,)], "n string")
    got = [r[0] for r in df.select(S.stand_in_key(F.lit(2026), F.col("n"), F.lit(7), F.lit("Practice 1"), F.lit("36"))).collect()]
    assert got == ["2026_ayumu_iwasa", "unknown_2026_r7_practice1_36", "unknown_2026_r7_practice1_36"]


def test_times(spark):
    df = spark.createDataFrame([("2024-05-01", "13:00:00Z"), ("2024-05-01", None), (None, "13:00:00Z")], "d string, t string")
    got = [r[0] for r in df.select(F.date_format(S.timestamp_at(F.col("d"), F.col("t"), "23:59:00Z"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-05-01 13:00:00", "2024-05-01 23:59:00", None]


def test_bases(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "q int")
    r = df.select(*[c.alias(n) for n, c in S.spline_basis(F.col("q")).items()]).collect()
    assert r[0]["q_log"] == 0 and r[0]["q_h0"] == 0
    assert r[1]["q_h0"] == 512 and r[1]["q_h4"] == 1 and r[1]["q_h5"] == 0
    assert abs(r[2]["q_log"] - np.log(20)) < 1e-12
    hot = df.select(*S.one_hot_basis(F.col("q")).values()).collect()
    assert [sum(x) for x in hot] == [1, 1, 0]


def test_unescape_as_the_standard_library(spark):
    texts = ["a &amp; b", "&amp;lt;", "&eacute;t&eacute;", "&#233;&#x1F600;", "AT&T; &unknown; &", "&copy;&middot;&nbsp;x", "&notin; &notit &ampx &amp &lt&gt;", "&hellip;&star;&NotEqualTilde;", "&#128;&#129;&#0;&#xD800;&#x110000;&#99999999999;",
             "&#65 &#x41z &#;&#x;", "&Aacute&aacute;", "&apos;&bigstar;", "&&amp;&"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.unescape(F.col("t"))).collect()] == [html.unescape(t) for t in texts]


PAGE = """<html><script>var x = "1 2 Nobody Here NOB ";</script><style>p{}</style><table>
<tr><td>1</td><td>4</td><td>Ana Alpha</td><td>ALP</td><td>1:10.1</td></tr><tr><td>2</td><td>16</td><td>Ben Beta</td><td>BET</td><td>1:10.4</td></tr>
<tr><td>3</td><td>81</td><td>Cy Gamma</td><td>GAM</td><td>1:11.0</td></tr></table>
<p>Note - %s</p> OUR PARTNERS</html>"""


def test_only_the_given_references_are_replaced_in_turn(spark):
    html_ = "<p>a&amp b&lt;\u00a0&&amp;c&amp;quot;d\x0b&quot; \n\t&copy;</p>"
    got = spark.createDataFrame([(html_,)], "t string").select(X.page_text(F.col("t"), {"&quot;": '"', "&copy;": "©", "&amp;": "&"})).first()[0]
    assert got == ' a&amp b&lt;\u00a0&&c&quot;d\x0b" © '


def test_halves_are_rounded_by_their_binary_value(spark):
    values = [1.3689045 / 3, 0.0955125 / 3, 0.3774315 / 3, 2.5, -2.5e-6, 0.0, -1.25, 1e300, None]
    want = [0.456302, 0.031837, 0.12581, 2.5, -3e-6, 0.0, -1.25, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(S.half_away(F.col("x"), 6)).collect()]
    assert got == want


def grid_of(spark, note, verified=()):
    pages = spark.createDataFrame([(1, PAGE % note)], "page_id int, html string").withColumn("text", X.page_text(F.col("html")))
    ok = spark.createDataFrame(list(verified), "page_id int, code string")
    return rows(X.attribute_notes(X.grid_rows(pages), X.notes(pages), ok), "code", "grid", "pit_lane_start", "attribution")


def test_grid_page_rows_and_named_note(spark):
    got = grid_of(spark, "Beta will start from the pit lane. Gamma has a penalty.")
    assert got == [("ALP", 1, False, "none"), ("BET", 2, True, "sentence"), ("GAM", 3, False, "none")]


def test_unnamed_note_leaves_the_event_unknown_unless_verified(spark):
    note = "Gamma was disqualified. Required to start from the pit lane."
    assert grid_of(spark, note) == [(c, g, None, "unresolved") for c, g in (("ALP", 1), ("BET", 2), ("GAM", 3))]
    assert grid_of(spark, note, [(1, "GAM")]) == [("ALP", 1, False, "none"), ("BET", 2, False, "none"), ("GAM", 3, True, "note subject verified")]


def test_a_note_is_read_to_its_end(spark):
    long = "Alpha is fine. " + "x" * 700 + ". Beta will start from the pit lane."
    assert grid_of(spark, long) == [("ALP", 1, False, "none"), ("BET", 2, True, "sentence"), ("GAM", 3, False, "none")]
    pages = spark.createDataFrame([(1, "Note: to the end of the pit lane. "), (2, "Noted - nothing"), (3, None)], "page_id int, text string")
    assert rows(X.notes(pages)) == [(1, "to the end of the pit lane.", ["to the end of the pit lane."]), (2, "", []), (3, "", [])]


def test_grid_rows_of_any_field(spark):
    names = [chr(65 + i // 26) + chr(65 + i % 26) + "X" for i in range(30)]
    text = "Pos No " + " ".join(f"{i + 1} {i + 40} Jo van d'Or-{c.lower()} {c} 1:{i:02d}.0" for i, c in enumerate(names))
    pages = spark.createDataFrame([(1, text), (2, "1 2 Ab CDE x 3 4 5 No NUM 6 7 WHO Ann ANN 1 2 Ab CDE"), (3, ""), (4, None)], "page_id int, text string")
    got = X.grid_rows(pages)
    assert rows(got.where("page_id = 1"), "grid", "number", "name", "code") == sorted(
        ((i + 1, i + 40, f"Jo van d'Or-{c.lower()}", c) for i, c in enumerate(names)), key=repr)
    assert rows(got.where("page_id > 1"), "page_id", "grid", "name", "code") == [(2, 1, "Ab", "CDE"), (2, 4, "No", "NUM"), (2, 6, "WHO Ann", "ANN")]


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from cutline.session import checkpoint_root

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=context))


def test_replicate_weights_are_the_same_in_a_table(spark):
    from cutline.functions.chance import poisson_table

    events = [0, 1, 7, -3, 2**40 + 5, 2**62]
    df = spark.createDataFrame([(e,) for e in events], "e bigint").crossJoin(spark.range(50).withColumnRenamed("id", "r"))
    want = {(r["e"], r["r"]): r["w"] for r in df.select("e", "r", poisson_one(uniform(F.col("e"), F.col("r"), seed=11)).alias("w")).collect()}
    got = poisson_table(np.array(events), 50, 11)
    assert all(got[i, r] == want[e, r] for i, e in enumerate(events) for r in range(50))


def test_uniform_is_uniform_and_uncorrelated(spark):
    df = spark.range(400).crossJoin(spark.range(300).withColumnRenamed("id", "r"))
    p = df.select("id", "r", uniform(F.col("id"), F.col("r")).alias("u"), poisson_one(uniform(F.col("id"), F.col("r"))).alias("w")).toPandas()
    u = p.pivot(index="id", columns="r", values="u").to_numpy()
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.std() - 12 ** -0.5) < 0.005
    assert u.min() > 0 and u.max() < 1 and len(np.unique(u)) > 0.999 * u.size
    for a, b in ((u[:, 1:], u[:, :-1]), (u[1:], u[:-1]), (u[2:], u[:-2])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.02
    # Replicate means spread as independent draws would.
    spread = u.mean(axis=0).std() / (12 ** -0.5 / 20)
    assert 0.85 < spread < 1.15
    assert abs(p["w"].mean() - 1) < 0.01 and abs(p["w"].var() - 1) < 0.03
