import random

import pytest
from pyspark.sql import functions as F

from claimscope.operators import search

STRUCT = "facility_id string, verified_capabilities array<struct<capability:string,confidence:double>>, operational_hours string"


def world(spark, n=80, seed=5):
    rng = random.Random(seed)
    states, kinds = ["Bihar", "New Delhi", "Goa", "Bi"], ["Hospital", "Clinic", "PHC"]
    caps = ["ICU", "Dialysis Unit", "Cardiac Care", "Care", "dialysis", "Eye"]
    vocab = ["dialysis", "hospital", "care", "trauma", "beds", "staff", "dialysisunit"]
    fac = []
    for i in range(n):
        s = states[0] if rng.random() < 0.4 else rng.choice(states)
        fac.append({
            "facility_id": f"f{i:03d}", "facility_name": f"N{i}", "state": s, "district": f"{s}-{i % 3}", "facility_type": rng.choice(kinds),
            "unstructured_notes": None if i % 9 == 0 else " ".join(rng.choices(vocab, k=6)).upper(),
            "caps": [rng.choice(caps) for _ in range(rng.randrange(4))],
            "trust": None if i % 5 == 0 else rng.randrange(101),
        })
    raw = spark.createDataFrame(
        [tuple(f[c] for c in ("facility_id", "facility_name", "state", "district", "facility_type", "unstructured_notes")) for f in fac],
        "facility_id string, facility_name string, state string, district string, facility_type string, unstructured_notes string",
    )
    structured = spark.createDataFrame(
        [(f["facility_id"], [(c, 0.5) for c in f["caps"]], None) for f in fac if f["caps"] or f["facility_id"] > "f040"], STRUCT
    )
    trust = spark.createDataFrame([(f["facility_id"], f["trust"]) for f in fac if f["trust"] is not None], "facility_id string, trust_score int")
    return fac, raw, structured, trust


def relevance(f, query):
    q = query.lower()
    words = q.split()
    score = 30 * (f["state"].lower() in q or f["district"].lower() in q) + 20 * (f["facility_type"].lower() in q)
    hit = [c.lower() for c in f["caps"] if c.lower() in q or any(w in c.lower() for w in words)]
    notes = (f["unstructured_notes"] or "").lower()
    score += 25 * len(hit) + 5 * sum(len(w) > 3 and w in notes for w in words)
    trust = 50 if f["trust"] is None else f["trust"]
    return score + trust // 10, trust, [c.title() for c in hit]


QUERIES = ["Dialysis in Bihar", "care care beds  dialysis", "clinic", "zzz", "i", "trauma hospital new delhi-1", "eye ICU goa"]


def test_lexical_search_equals_brute_force(spark):
    fac, raw, structured, trust = world(spark)
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = {}
    for r in search.lexical_search(qs, raw, structured, trust, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.facility_id, r.score, r.trust_score, list(r.matching_capabilities)))
    for i, q in enumerate(QUERIES):
        scored = [(f["facility_id"], *relevance(f, q)) for f in fac]
        best = sorted((s for s in scored if s[1] > 0), key=lambda s: (-s[1], s[0]))[:7]
        want = [(n + 1, fid, score, trust_, hit) for n, (fid, score, trust_, hit) in enumerate(best)]
        assert sorted(got.get(i, [])) == want, q


def test_contained_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("ab ", k=n))
    texts = {word(rng.randrange(1, 12)) for _ in range(60)} | {"x" * 60, "né \U0001f600ab", "日本語a"}
    terms = {word(rng.randrange(1, 4)) for _ in range(30)} | {"x" * 41, "x" * 61, "", "\U0001f600a", "本語"}
    got = search.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.text, r.term) for r in got.collect()} == {(a, b) for a in texts for b in terms if b and b in a}
    assert got.count() == got.distinct().count()


INTENTS = [(1, None, None, None), (2, "Bi", None, None), (3, "Bi", "-1", 40), (4, None, "Delhi-2", None), (5, "Nowhere", None, None), (6, None, None, 95), (7, "Goa", None, 0)]


def test_retrieve_equals_brute_force(spark):
    fac, raw, _, trust = world(spark)
    intents = spark.createDataFrame(INTENTS, "query_id int, location_state string, location_district string, min_trust_score int")
    got = {}
    for r in search.retrieve(intents, raw, trust, 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.facility_id))
    for qid, s, d, floor in INTENTS:
        ok = [
            f for f in fac
            if (not s or s in f["state"]) and (not d or d in f["district"]) and (not floor or (f["trust"] is not None and f["trust"] >= floor))
        ]
        ok.sort(key=lambda f: (f["trust"] is None, -(f["trust"] or 0), f["facility_id"]))
        assert sorted(got.get(qid, [])) == [(n + 1, f["facility_id"]) for n, f in enumerate(ok[:6])], qid


def test_intents(spark):
    df = spark.createDataFrame(
        [(1, 'x {"capabilities": ["icu"], "location_state": "", "min_trust_score": "70", "max_distance_km": 5}'), (2, "none"), (3, "{broken}")],
        "query_id int, response string",
    )
    rows = {r.query_id: r for r in search.parse_intents(df).collect()}
    assert (rows[1].capabilities, rows[1].location_state, rows[1].min_trust_score, rows[1].max_distance_km) == (["icu"], None, 70, 5.0)
    assert rows[2].capabilities == [] and rows[3].location_state is None


def test_rule_intents_find_long_names_and_ignore_punctuation(spark):
    raw = spark.createDataFrame([("Delhi", "The Old Town By The Sea"), ("Dadra & Nagar", "X-1")], "state string, district string")
    q = spark.createDataFrame([(1, "dialysis in Delhi, please"), (2, "(the old town by the sea)!"), (3, "Dadra & Nagar: x-1?"), (4, "newdelhi")], "query_id int, query string")
    got = {r.query_id: (r.location_state, r.location_district) for r in search.rule_intents(q, raw).collect()}
    assert got == {1: ("Delhi", None), 2: (None, "The Old Town By The Sea"), 3: ("Dadra & Nagar", "X-1"), 4: (None, None)}


def test_rule_intents(spark):
    _, raw, _, _ = world(spark)
    q = spark.createDataFrame([(1, "Dialysis in NEW Delhi within 25 km of 110001, trust above 60, open 24/7"), (2, "hello")], "query_id int, query string")
    rows = {r.query_id: r for r in search.rule_intents(q, raw).collect()}
    r = rows[1]
    assert (r.location_state, r.location_pin_code, r.max_distance_km, r.min_trust_score) == ("New Delhi", "110001", 25.0, 60)
    assert r.categories == ["dialysis"] and r.operational_constraints == ["24/7"]
    assert rows[2].location_state is None and rows[2].categories == []


def test_broadening_takes_the_first_sufficient_tier(spark):
    raw = spark.createDataFrame([(f"f{i}", "A" if i < 4 else "B") for i in range(8)], "facility_id string, state string")
    structured = spark.createDataFrame([(f"f{i}", [("Dialysis", 0.9)], None) for i in range(8)], STRUCT)
    trust = spark.createDataFrame([(f"f{i}", 10 * i) for i in range(8)], "facility_id string, trust_score int")
    intents = spark.createDataFrame(
        [(1, ["dialysis"], "A", 10), (2, ["dialysis"], "A", 30), (3, ["dialysis"], "Z", None), (4, ["icu"], "A", None), (5, [], "A", None)],
        "query_id int, categories array<string>, location_state string, min_trust_score int",
    )
    got = {}
    for r in search.broadened(intents, raw, structured, trust).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.tier, r.facility_id))
    assert got[1] == [(1, "f3"), (1, "f2"), (1, "f1")]
    assert got[2] == [(2, "f3"), (2, "f2"), (2, "f1"), (2, "f0")]
    assert got[3] == [(3, f"f{i}") for i in (7, 6, 5, 4, 3)]
    assert 4 not in got
    assert got[5] == [(1, f"f{i}") for i in (3, 2, 1, 0)]  # no category: all of them


def test_weighted_rank(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0, 1.0, 100), (1, "b", None, None, None), (1, "c", 50.0, 0.5, 50)], "query_id int, facility_id string, km double, confidence double, facility_trust int"
    )
    got = {r.facility_id: (r.rank, r.weight) for r in search.weighted_rank(df).collect()}
    assert got["a"] == (1, pytest.approx(1.0)) and got["b"] == (3, 0.0) and got["c"] == (2, pytest.approx(0.25 + 0.15 + 0.1))


def test_no_pair_of_query_and_facility_is_planned(spark):
    _, raw, structured, trust = world(spark)
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    intents = spark.createDataFrame(INTENTS, "query_id int, location_state string, location_district string, min_trust_score int")
    for df in (search.lexical_search(qs, raw, structured, trust), search.retrieve(intents, raw, trust)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_explained_rows(spark):
    _, raw, structured, trust = world(spark)
    intents = spark.createDataFrame(INTENTS[:2], "query_id int, location_state string, location_district string, min_trust_score int")
    rows = search.intent_rank(intents, raw, trust, structured, 3).where(F.col("query_id") == 1).collect()
    assert len(rows) == 3 and all(r.justification.startswith(r.facility_name + " in ") for r in rows)


def test_equal_queries_are_asked_once(spark):
    rows = [(1, "icu"), (2, "icu"), (3, "dialysis"), (4, None), (5, None), (6, "icu"), (6, "dialysis"), (7, "dialysis"), (7, "icu"), (8, "icu"), (8, "icu"), (None, "icu")]
    asked, same = search.different(spark.createDataFrame(rows, "query_id int, query string"))
    assert sorted((r.query_id, r.asked_id) for r in same.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8)]
    assert sorted((r.query_id, r.query or "") for r in asked.collect()) == [(1, "icu"), (3, "dialysis"), (4, ""), (6, "dialysis"), (6, "icu"), (8, "icu"), (8, "icu")]
