import numpy as np
import pytest

from claimscope.operators import geo, nearest


def points(kind, rng, n):
    if kind == "globe":
        lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
        lon = rng.uniform(-180, 180, n)
        lon[: n // 4] = np.where(rng.random(n // 4) < 0.5, 180, -180) + rng.uniform(-0.5, 0.5, n // 4)
        lon = (lon + 180) % 360 - 180
    elif kind == "pole":
        lat, lon = rng.uniform(78, 90, n), rng.uniform(-180, 180, n)
    elif kind == "city":  # most points crowd into one city
        lat, lon = rng.uniform(8, 36, n), rng.uniform(68, 97, n)
        m = 2 * n // 3
        lat[:m], lon[:m] = 19 + rng.normal(0, 0.03, m), 73 + rng.normal(0, 0.03, m)
        lat[: m // 4], lon[: m // 4] = 19.01, 73.01  # and many on one spot
    return lat, lon


def haversine(a, o, b, p):
    a, o, b, p = map(np.radians, (a, o, b, p))
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((p - o) / 2) ** 2
    h = np.minimum(h, 1.0)
    return 2 * 6371 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def frames(spark, kind, n_points, n_pins, seed):
    rng = np.random.default_rng(seed)
    plat, plon = points(kind, rng, n_points)
    qlat, qlon = points(kind, rng, n_pins)
    cats = rng.integers(0, 2, n_points)
    pts = [("ab"[c], f"p{i:05d}", float(x), float(y), 60) for i, (c, x, y) in enumerate(zip(cats, plat, plon))]
    pins = [(f"q{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(zip(qlat, qlon))]
    return (
        spark.createDataFrame(pins, "pin_code string, latitude double, longitude double"),
        spark.createDataFrame(pts, "category string, facility_id string, latitude double, longitude double, trust_score int"),
        pins, pts,
    )


@pytest.mark.parametrize("kind,rounds,crowded", [("globe", 1, 4), ("pole", 2, 4), ("city", 3, 8), ("city", 0, 8)])
def test_nearest_equals_brute_force(spark, kind, rounds, crowded):
    where, pts_df, pins, pts = frames(spark, kind, 1500, 120, seed=rounds + 7)
    got = {(r.pin_code, r.category): (r.facility_id, r.km) for r in nearest.nearest(where, pts_df, ["a", "b", "none"], rounds=rounds, crowded=crowded).collect()}
    assert len(got) == 2 * len(pins)
    for cat in "ab":
        mine = sorted(p for p in pts if p[0] == cat)
        lat, lon = np.array([p[2] for p in mine]), np.array([p[3] for p in mine])
        for pin, y, x in pins:
            d = haversine(y, x, lat, lon)
            fid, km = got[(pin, cat)]
            assert km == pytest.approx(d.min(), abs=1e-6)
            assert d[[p[1] for p in mine].index(fid)] == pytest.approx(d.min(), abs=1e-6)


@pytest.mark.parametrize("kind,radius", [("city", 3.0), ("globe", 900.0)])
def test_counts_within_equal_brute_force(spark, kind, radius):
    where, pts_df, pins, pts = frames(spark, kind, 1200, 60, seed=3)
    got = {(r.pin_code, r.category): r.n_within for r in nearest.count_within(where, pts_df, radius, rounds=2, crowded=4).collect()}
    for cat in "ab":
        lat, lon = (np.array([p[i] for p in pts if p[0] == cat]) for i in (2, 3))
        for pin, y, x in pins:
            assert got.get((pin, cat), 0) == int((haversine(y, x, lat, lon) <= radius).sum())


def test_ties_go_to_the_lowest_id(spark):
    pts = spark.createDataFrame(
        [("a", "z", 1.0, 1.0, 70), ("a", "b", 1.0, 1.0, 80), ("a", "c", 1.0, 3.0, 90)],
        "category string, facility_id string, latitude double, longitude double, trust_score int",
    )
    where = spark.createDataFrame([("p", 1.0, 2.0), ("null", None, 2.0)], "pin_code string, latitude double, longitude double")
    rows = nearest.nearest(where, pts, ["a"]).collect()
    assert [(r.pin_code, r.facility_id, r.trust_score) for r in rows] == [("p", "b", 80)]


def test_scores_and_unserved(spark):
    raw = spark.createDataFrame(
        [("f1", "S", "D", "100001", 10.0, 70.0), ("f2", "S", "D", "100002", 11.0, 70.0), ("f3", "S", "D", "100003", None, 70.0)],
        "facility_id string, state string, district string, pin_code string, latitude double, longitude double",
    )
    s = spark.createDataFrame(
        [("f1", [("Dialysis Unit", 0.5)]), ("f2", [("dialysis", 0.9)]), ("f3", [("ICU", 0.9)])],
        "facility_id string, verified_capabilities array<struct<capability:string,confidence:double>>",
    )
    t = spark.createDataFrame([("f1", 0), ("f2", 59)], "facility_id string, trust_score int")
    near = lambda **kw: sorted((r.pin_code, r.capability, r.nearest_facility_id, r.desert_severity) for r in geo.nearest_verified(raw, s, t, **kw).collect())
    # A zero score counts as 70, so f1 is verified and f2 is not.
    assert near() == [("100001", "dialysis", "f1", "green"), ("100002", "dialysis", "f1", "red")]
    assert near(default_trust=None) == []
    assert near(default_trust=None, min_trust_score=50, min_confidence=0.7) == [("100001", "dialysis", "f2", "red"), ("100002", "dialysis", "f2", "green")]
    rows = near(include_unserved=True)
    assert len(rows) == 20 and ("100001", "icu", None, "red") in rows


def test_reports(spark):
    lookup = spark.createDataFrame(
        [("221001", "a", "f3", 85.0, 62, "yellow"), ("221001", "b", "f2", 120.0, 78, "red"), ("842001", "b", "f3", 120.0, 62, "red"), ("x", "a", "f1", 1.0, 90, "green")],
        "pin_code string, capability string, nearest_facility_id string, distance_km double, nearest_trust_score int, desert_severity string",
    )
    r = geo.pin_access(lookup, "221001").first()
    assert (r.distance_km, r.desert_severity) == (85.0, "yellow")
    assert {x.pin_code for x in geo.pin_access(lookup).collect()} == {"221001", "842001"}
    assert [(x.pin_code, x.n_red) for x in geo.red_zones(lookup).collect()] == [("221001", 1), ("842001", 1)]
    roll = {x.pin_code: (x.desert_severity, x.distance_km, x.nearest_facility_id) for x in geo.map_rollup(lookup).collect()}
    assert roll["221001"] == ("red", 85.0, "f3")
    none = {x.desert_severity: (x.n, x.pct) for x in geo.severity_distribution(lookup.limit(0)).collect()}
    assert none == {"green": (0, 0.0), "yellow": (0, 0.0), "red": (0, 0.0)}
