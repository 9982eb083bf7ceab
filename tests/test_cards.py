"""Distances, speeds and areas as text at their edges; texts of quests without what they need."""

from pyspark.sql import functions as F

from strideframe.functions import cards, units


def texts(spark, values, how):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r.t for r in df.select("i", how(F.col("v")).alias("t")).orderBy("i").collect()]


def test_distances(spark):
    metric = lambda v: units.distance(v)
    assert texts(spark, [0.0, 2.0, 3.0, 97.0, 99.0, 994.0, 995.0, 1440.0, 2000.0, 9960.0, 12_400.0, -5.0, float("nan"), float("inf"), None], metric) == [
        "0 m", "0 m", "5 m", "95 m", "100 m", "990 m", "1 km", "1.4 km", "2 km", "10 km", "12 km", "0 m", "–", "–", "–"]
    imperial = lambda v: units.distance(v, F.lit(True))
    assert texts(spark, [0.0, 17.07, 158.0, 0.1 * 1609.344, 1609.344], imperial) == ["0 ft", "60 ft", "520 ft", "0.1 mi", "1 mi"]
    assert texts(spark, [41.0, 45.0, 300.0], lambda v: units.distance(v, rounding="down")) == ["40 m", "45 m", "300 m"]
    assert texts(spark, [41.0, 45.0, 996.0], lambda v: units.distance(v, rounding="up")) == ["45 m", "45 m", "1 km"]


def test_speeds_and_areas(spark):
    assert texts(spark, [0.0, 4.6, 100.0, None], lambda v: units.speed(v, F.lit(False))) == ["0 km/h", "5 km/h", "100 km/h", "–"]
    assert texts(spark, [100.0], lambda v: units.speed(v, F.lit(True))) == ["62 mph"]
    assert texts(spark, [0.0, 10.0, 1.24e6, 9.97e6, 5e7], lambda v: units.area(v, F.lit(False))) == ["0 km²", "<0.1 km²", "1.2 km²", "10 km²", "50 km²"]


def test_quests_without_what_they_need_have_no_text(spark):
    columns = "target string, kind string, r double, minutes double, coverage double, len_m double, limit_min double, n long, theme string, name string, place string"
    rows = [(t, None, None, None, None, None, None, None, None, "Q", None) for t in ("collect", "steps", "flying", None, "round_trip")]
    df = spark.createDataFrame(rows, columns)
    q = {c: F.col(c) for c in df.columns}
    got = df.select(cards.goal_text(q, F.lit(False)).alias("goal"), cards.title(q, F.lit(True)).alias("title")).collect()
    assert [r.goal for r in got] == [None, None, None, None, "Reach the far point, then come back home"]
    assert [r.title for r in got] == [None, *["The Big One: Q"] * 4]
