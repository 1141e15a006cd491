import datetime as dt

from claimscope.operators import ingest, quality


def clean(spark, rows, schema):
    """Cleaned rows by number, in order of their ids; rows come back in any order, so those without ids get numbered ones."""
    if "id string" not in schema:
        rows, schema = [(*r, f"{i:04d}") for i, r in enumerate(rows)], schema + ", facility_id string"
    cleaned = ingest.clean(spark.createDataFrame(rows, schema), dt.datetime(2024, 1, 2)).collect()
    return dict(enumerate(sorted(cleaned, key=lambda r: r.facility_id)))


def test_column_names():
    assert ingest.target_of(" Address-ZipOrPostcode ") == "pin_code"
    assert ingest.target_of("Facility ID") == "facility_id"
    assert ingest.target_of("website") is None
    report = ingest.mapping_report(["Name", "Facility_Name", "website"])
    assert report["unmapped"] == ["website"] and report["collisions"] == ["facility_name"]
    assert "latitude" in report["missing"] and "facility_name" not in report["missing"]


def test_null_pin_takes_the_default(spark):
    rows = clean(spark, [("a", None), ("a", ""), ("a", "None"), ("a", "110001.0"), ("a", "100010")], "name string, pin string")
    assert [r.pin_code for r in rows.values()] == ["000000", "000000", "000000", "110001", "100010"]


def test_two_columns_for_one_target_are_merged_in_order(spark):
    rows = clean(spark, [("a", "b"), (None, "b"), (None, None)], "name string, facility_name string")
    assert [r.facility_name for r in rows.values()] == ["a", "b", None]


def test_only_whole_numbers_are_beds(spark):
    rows = clean(spark, [("10",), ("10.0",), ("10.5",), ("many",), (None,), ("1e2",)], "beds string")
    assert [r.bed_count for r in rows.values()] == [10, 10, None, None, None, 100]


def test_notes_are_labelled_and_replace_mapped_ones(spark):
    rows = clean(
        spark,
        [("n", "old", "Ward 1", " ", "x"), ("n", "old", None, "", None)],
        "name string, remarks string, description string, specialties string, Procedure string",
    )
    assert rows[0].unstructured_notes == "Description: Ward 1\n\nProcedure: x"
    assert rows[1].unstructured_notes == "" and rows[1].missing_fields == ["unstructured_notes"]


def test_mapped_notes_stand_without_note_columns(spark):
    assert clean(spark, [("n", "text")], "name string, remarks string")[0].unstructured_notes == "text"


def test_validation(spark):
    rows = clean(spark, [("None", "x"), ("", "x"), (None, None), ("  ", "x"), ("ok", "None")], "name string, notes string")
    assert [r.missing_fields for r in rows.values()] == [
        ["facility_name"], ["facility_name"], ["facility_name", "unstructured_notes"], [], ["unstructured_notes"],
    ]


def test_ids_are_stable_and_counted_before_rejection(spark):
    src = [(None, "a", "x"), ("", None, "x"), ("k", "a", "x")]
    schema = "id string, name string, notes string"
    one, two = clean(spark, src, schema), clean(spark, src, schema)
    assert [r.facility_id for r in one.values()] == [r.facility_id for r in two.values()]
    assert len({r.facility_id for r in one.values()}) == 3 and one[2].facility_id == "k"
    s = ingest.stats(ingest.clean(spark.createDataFrame(src, schema))).first()
    assert (s.original_row_count, s.valid_row_count, s.skipped_row_count, s.generated_id_count) == (3, 2, 1, 2)


def test_load_time_is_the_callers(spark):
    assert clean(spark, [("a",)], "name string")[0].ingested_at == dt.datetime(2024, 1, 2)


def test_quality_reports(spark):
    df = spark.createDataFrame([("a", "s", "d", 1.0, 2.0), ("a", "s", None, None, 2.0), ("b", None, "d", None, None)],
                               "facility_id string, state string, district string, latitude double, longitude double")
    u = quality.uniqueness(df).first()
    assert (u.total_rows, u.unique_keys, u.duplicates) == (3, 2, 1)
    c = quality.coverage(df).first()
    assert (c.n_states, c.n_districts) == (2, 2)
    p = quality.coordinates(df).first()
    assert (p.with_coordinates, p.pct_with_coordinates) == (1, 33.3)
    assert quality.coordinates(df.limit(0)).first().pct_with_coordinates is None
    n = {r.field: r.n_null for r in quality.null_counts(df, ["state", "district"]).collect()}
    assert n == {"state": 1, "district": 1}


def test_equal_rows_without_id_get_different_ids(spark):
    """A hot equal row spread over many partitions: as many ids as rows, and the same ones in another run."""
    rows = [(None, "Camp", "note")] * 500 + [("", "Camp", "note")] * 10 + [(f"f{i}", "Camp", "note") for i in range(20)] + [(None, "Other", None)]
    columns = "facility_id string, Name string, description string"
    runs = [{r.facility_id for r in ingest.clean(spark.createDataFrame(rows, columns).repartition(n)).where("id_generated").collect()} for n in (1, 7)]
    assert len(runs[0]) == 511 and runs[0] == runs[1]
    one = ingest.clean(spark.createDataFrame(rows[-2:], columns)).collect()
    assert sorted(r.id_generated for r in one) == [False, True] and {r.facility_id for r in one} - {"f19"} <= runs[0]
    assert ingest.clean(spark.createDataFrame([], columns)).count() == 0
