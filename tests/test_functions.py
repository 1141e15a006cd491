import pytest
from pyspark.sql import functions as F

from claimscope.functions import classify, geo, jsontext, text, vectors


def one(spark, *cols, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*cols).first()


def test_haversine_known_distances(spark):
    km = lambda *p: one(spark, geo.haversine_km(*[f"{x}D" for x in p]).alias("km")).km
    assert km(0, 0, 0, 1) == pytest.approx(111.195, abs=1e-3)
    assert km(28.5672, 77.21, 19.0176, 72.8562) == pytest.approx(1150.24, abs=1e-2)
    assert km(25.6093, 85.1376, 26.1209, 85.3647) == pytest.approx(61.26, abs=1e-2)
    assert km(12.5, 77.5, 12.5, 77.5) == 0
    assert km(10, 20, 30, 40) == pytest.approx(km(30, 40, 10, 20), abs=1e-9)
    assert km(0, 0, 0, 180) == pytest.approx(6371 * 3.14159265, abs=1e-3)
    assert km(37.3, 11.1, -37.3, -168.9) > 20000  # antipodes stay finite


def test_severity_limits(spark):
    rows = spark.createDataFrame([(49.99,), (50.0,), (99.99,), (100.0,)], "km double").select(geo.severity(F.col("km")).alias("s"))
    assert [r.s for r in rows.collect()] == ["green", "yellow", "yellow", "red"]


def test_pin(spark):
    lat, lon = geo.pin_region_point(F.col("p"))
    df = spark.createDataFrame([("110001",), ("9",), (None,)], "p string")
    rows = df.select(lat.alias("a"), lon.alias("o"), geo.is_pin(F.col("p")).alias("ok")).collect()
    assert [(r.a, r.o, r.ok) for r in rows] == [(28.6, 77.2, True), (22.5, 78.5, False), (22.5, 78.5, None)]


def test_sentences_give_exact_offsets(spark):
    s = "  One here. Two!  Is it three?\nLast without a stop... ok"
    got = one(spark, text.sentences(F.col("t")).alias("x"), t=s).x
    assert [x.sentence for x in got] == ["One here.", "Two!", "Is it three?", "Last without a stop...", "ok"]
    for x in got:
        assert s[x.start:x.start + len(x.sentence)] == x.sentence
    assert one(spark, text.sentences(F.col("t")).alias("x"), t="").x == []


@pytest.mark.parametrize("s", ["x-ray mri 24/7 o'clock", "ICU WITH care", "", "  two  spaces"])
def test_title_case_is_pythons(spark, s):
    assert one(spark, text.title_case(F.col("t")).alias("x"), t=s).x == s.title()


def test_render_fills_once(spark):
    got = one(spark, text.render("a {x} b {y} {z} {x}", {"x": F.col("x"), "y": F.col("y")}).alias("r"), x="{y}", y=None).r
    assert got == "a {y} b  {z} {y}"


def test_truncate(spark):
    assert one(spark, text.truncate(F.col("t"), 3).alias("r"), t="abcd").r == "abc..."
    assert one(spark, text.truncate(F.col("t"), 4).alias("r"), t="abcd").r == "abcd"
    assert one(spark, text.snippet(F.col("t"), 9).alias("r"), t="abcd").r == "abcd..."


def test_json_helpers(spark):
    span = lambda s: one(spark, jsontext.json_span(F.col("t")).alias("r"), t=s).r
    assert span('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert span('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert span("none") == "none"
    ok = lambda s: one(spark, jsontext.is_json_object(F.col("t")).alias("r"), t=s).r
    assert ok('{"a": 1}') and not ok('{"a": ') and not ok("none") and not ok("[1]")


def test_classes(spark):
    df = spark.createDataFrame([(None,), (0,), (19,), (20,), (49,), (50,), (69,), (70,), (80,), (100,)], "s int")
    rows = df.select(classify.trust_band(F.col("s")).alias("b"), classify.trust_color(F.col("s")).alias("c")).collect()
    assert [r.b for r in rows] == [None, "0-19", "0-19", "20-39", "40-59", "40-59", "60-79", "60-79", "80-100", "80-100"]
    assert [r.c for r in rows] == ["unscored", "unscored", "red", "red", "red", "yellow", "yellow", "green", "green", "green"]
    kinds = spark.createDataFrame([("Government Hospital",), ("Clinic",), ("Primary Health Center",), (None,)], "t string")
    assert [r.k for r in kinds.select(classify.facility_class(F.col("t")).alias("k")).collect()] == ["hospital", "clinic", "other", "other"]


def test_keywords_overlap(spark):
    got = one(spark, classify.categories_of("t").alias("c"), t="Critical Care after EMERGENCY surgery").c
    assert got == ["emergency_surgery", "trauma", "icu"]
    assert one(spark, classify.categories_of("t").alias("c"), t="dental").c == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2 ** -0.5) and got[1] is None and got[2] is None


def test_hashed_terms(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(vectors.hashed_terms("t", 16).alias("v"))
    v, empty, null = [r.v for r in df.collect()]
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1.0, abs=1e-6)
    assert empty is None and null is None
