import json

from claimscope.operators import extract, infer, trust


def profile(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "facility_id string, response string")
    return {r.facility_id: r for r in extract.parse_profiles(df).collect()}


def test_bad_elements_are_dropped(spark):
    good = {"capability": "ICU", "confidence": "0.8", "evidence_sentence": "ICU.", "evidence_offset": 3}
    body = {
        "verified_capabilities": [
            good, {**good, "confidence": 1.01}, {**good, "confidence": "high"}, {**good, "evidence_offset": 1.5},
            {k: v for k, v in good.items() if k != "evidence_sentence"}, {**good, "confidence": 0, "evidence_offset": "7"},
        ],
        "staff": [{"role": "Nurse"}, {"role": ""}, {"role": None}, {}],
        "equipment": [{"item": "MRI", "functional": False}, {"item": "CT"}, {"item": "", "functional": True}, {"item": "US", "functional": "true"}],
        "operational_hours": None,
    }
    r = profile(spark, "```json\n" + json.dumps(body) + "\n```")["0"]
    assert [(c.confidence, c.evidence_offset) for c in r.verified_capabilities] == [(0.8, 3), (0.0, 7)]
    assert [s.role for s in r.staff] == ["Nurse"]
    assert [(e.item, e.functional) for e in r.equipment] == [("MRI", False), ("US", True)]
    assert r.operational_hours == "" and r.error is None


def test_null_lists_are_empty_and_broken_text_is_an_error(spark):
    r = profile(spark, '{"staff": null}', '{"staff": [', "no", None)
    assert r["0"].staff == [] and r["0"].error is None
    assert r["1"].error.startswith("JSON parse error") and r["2"].error and r["1"].verified_capabilities == []


def test_json_columns_round_trip(spark):
    df = spark.createDataFrame([("a", "{}")], "facility_id string, response string")
    p = extract.parse_profiles(df)
    back = extract.from_json_columns(extract.to_json_columns(p)).first()
    assert back.verified_capabilities == [] and back.staff == []
    bad = spark.createDataFrame([("a", "[{", None, "")], "facility_id string, verified_capabilities_json string, staff_json string, equipment_json string")
    r = extract.from_json_columns(bad).first()
    assert r.verified_capabilities == [] and r.staff == [] and r.equipment == []


def test_lexicon_tiers_and_offsets(spark):
    notes = "Kidney ward open. No dialysis today. Oncology unit. Oncology unit again. Not far."
    df = spark.createDataFrame([("a", notes), ("b", None), ("c", "")], "facility_id string, notes string")
    rows = {(r.facility_id, r.category): r for r in extract.lexicon_claims(df).collect()}
    assert set(rows) == {("a", "dialysis"), ("a", "oncology")}
    d, o = rows[("a", "dialysis")], rows[("a", "oncology")]
    assert (d.confidence, d.evidence_sentence) == (0.65, "Kidney ward open.")
    assert (o.confidence, o.evidence_offset) == (0.9, notes.index("Oncology"))
    g = extract.grounding(extract.lexicon_claims(df), df).collect()
    assert {r.grounding for r in g} == {"at_offset"}


def test_weakening_words_are_whole_words(spark):
    df = spark.createDataFrame([("a", "Casino dialysis unit."), ("b", "No dialysis unit."), ("c", "Dialysis is not offered.")], "facility_id string, notes string")
    assert {r.facility_id: r.confidence for r in extract.lexicon_claims(df).collect()} == {"a": 0.9, "b": 0.4, "c": 0.4}


def test_grounding_kinds(spark):
    notes = spark.createDataFrame([("a", "xx yes.")], "facility_id string, notes string")
    claims = spark.createDataFrame([("a", "yes.", 3), ("a", "yes.", 0), ("a", "no.", 0), ("z", "yes.", 0)],
                                   "facility_id string, evidence_sentence string, evidence_offset int")
    got = sorted((r.facility_id, r.evidence_offset, r.grounding, r.found_offset) for r in extract.grounding(claims, notes).where("evidence_sentence = 'yes.'").collect())
    assert got == [("a", 0, "moved", 3), ("a", 3, "at_offset", 3), ("z", 0, "missing", None)]


def verdict(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "facility_id string, judge_raw string")
    rows = {r.facility_id: r for r in trust.verdicts(df).collect()}
    return [(rows[str(i)].trust_score, rows[str(i)].judge_reasoning) for i in range(len(texts))]


def test_verdicts(spark):
    null_score = 'I say 42: {"trust_score": null, "reasoning": "r"}'
    got = verdict(
        spark, '{"trust_score": 85.7, "reasoning": "r"}', '{"trust_score": "85.7"}', '{"reasoning": "r"}', null_score,
        '{"trust_score": null}', "about 77 of 100", "nothing", '{"trust_score": 250, "reasoning": null}', '{"trust_score": -4}', '{"trust_score": 12',
    )
    assert [s for s, _ in got] == [85, 85, 50, 42, 50, 77, 50, 100, 0, 12]
    assert got[0][1] == "r" and got[1][1] == '{"trust_score": "85.7"}' and got[5][1] == "about 77 of 100" and got[7][1] is None


def contradictions(spark, text):
    df = spark.createDataFrame([("a", text)], "facility_id string, skeptic_raw string")
    return [(r.claim, r.evidence_gap, r.trust_impact, r.severity) for r in trust.contradictions(df).orderBy("contradiction_id").collect()]


def test_contradiction_lists(spark):
    assert contradictions(spark, 'CONTRADICTIONS_JSON:\n [{"claim": "x"}] and [{"claim": "y"}]') == [("x", "", -5, "medium")]
    assert contradictions(spark, 'see [{"claim": "y", "trust_impact": -3, "severity": "low"}]') == [("y", "", -3, "low")]
    assert contradictions(spark, 'see [{"note": "y"}]') == []
    assert contradictions(spark, "CONTRADICTIONS_JSON: []") == []
    # The shortest list ends at the first bracket: a nested one is cut and not valid JSON.
    assert contradictions(spark, 'CONTRADICTIONS_JSON: [{"claim": "x", "evidence_gap": ["a"]}]') == []
    assert contradictions(spark, "none") == []


def test_debate_stats_without_scores(spark):
    scores = spark.createDataFrame([], "facility_id string, trust_score int")
    contras = spark.createDataFrame([], "facility_id string")
    r = trust.debate_stats(scores, contras, spark.createDataFrame([("a",)], "facility_id string")).first()
    assert (r.total_facilities, r.successful_debates, r.failed_debates, r.total_contradictions, r.avg_trust_score) == (1, 0, 1, 0, 0.0)


def test_score_reports(spark):
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate([85, 78, 62, 45, 55, 92])], "facility_id string, trust_score int")
    s = trust.score_stats(df).first()
    assert (s.total_facilities, s.average_score, s.min_score, s.max_score) == (6, 69.5, 45, 92)
    d = trust.distribution(df).first()
    assert (d.band_40_59, d.band_60_79, d.band_80_100) == (2, 2, 2)
    assert {(r.bucket, r.n) for r in trust.histogram(df).collect()} == {(40, 2), (60, 2), (80, 2)}
    assert trust.lowest(df).first().facility_id == "f3"


def test_profile_summary_lines(spark):
    from catalog.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    rows = {r.structured_profile.split(":")[0] for r in trust.profile_summary(trust.debate_input(v.raw, v.structured)).collect()}
    assert "Capabilities" in rows


def test_model_errors_stay_in_their_row(spark):
    def fn(texts):
        if "bad" in texts:
            raise RuntimeError("429")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", " "), ("d", None), ("e", "y")], "facility_id string, prompt string").coalesce(1)
    rows = {r.facility_id: (r.response, r.error) for r in infer.batch_infer(df, fn, batch_size=10).collect()}
    assert rows == {
        "a": ("X", None), "b": (None, "RuntimeError: 429"), "c": (None, "empty text"), "d": (None, "empty text"), "e": ("Y", None),
    }
    s = infer.count_errors(infer.batch_infer(df, fn)).first()
    assert (s.total, s.successful, s.failed) == (5, 2, 3)


def test_tiers_cover_everyone_once(spark):
    fac = spark.createDataFrame([(f"f{i:02d}", "hot" if i % 3 else "x") for i in range(30)], "facility_id string, state string")
    full = fac.selectExpr("facility_id", "90 as trust_score")
    cheap = fac.selectExpr("facility_id", "50 as trust_score")
    got = trust.tiered(fac, full, cheap, ["hot"], 5).collect()
    assert len({r.facility_id for r in got}) == len(got) == 30
    assert sum(r.tier == "full" for r in got) == 5
