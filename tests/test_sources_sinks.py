import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanwave import schema
from spanwave.sinks import tables as sinks
from spanwave.sources import index_files
from spanwave.streaming import resume

SENSOR = "NEW_S1_DO_INF_STR"
INDEX = {
    "Record_UID": [1, 2],
    "File": ["a.json", "a.json"],
    "Start_Row": [1, 3],
    "End_Row": [2, 4],
    "Start_Time": ["2022-07-01 00:00:00.500000", "2022-07-01 00:01:00"],
    "End_Time": ["2022-07-01T00:00:01Z", "2022-07-01 02:01:01+02:00"],
    "Duration": [0.5, "bad"],
    "Tag": [["x"], ["y"]],
}


def rows_of(columns):
    return [dict(zip(columns, values)) for values in zip(*columns.values())]


@pytest.mark.parametrize(
    "content",
    [INDEX, {"records": rows_of(INDEX)}, rows_of(INDEX), {**INDEX, "duration": INDEX["Duration"], "Duration": None}],
    ids=["columns", "wrapped", "list", "other-case"],
)
def test_index_shapes(spark, tmp_path, content):
    content = {k: v for k, v in content.items() if v is not None} if isinstance(content, dict) else content
    folder = tmp_path / "SPAN_SET1_2022_07"
    folder.mkdir()
    (folder / f"TABLE_{SENSOR}_SET1.json").write_text(json.dumps(content))
    out = index_files.read_index_tables(spark, str(folder)).orderBy("record_uid").collect()
    assert [(r.set_name, r.deck, r.sensor_name, r.raw_file) for r in out] == [
        ("SPAN_SET1_2022_07", "NEW", SENSOR, "a.json")
    ] * 2
    assert [r.table_row for r in out] == [1, 2]
    assert [r.start_time_utc for r in out] == [datetime(2022, 7, 1, 0, 0, 0, 500000), datetime(2022, 7, 1, 0, 1)]
    assert [r.end_time_utc for r in out] == [datetime(2022, 7, 1, 0, 0, 1), datetime(2022, 7, 1, 0, 1, 1)]
    assert [r.duration for r in out] == [0.5, None]
    assert [r.tag for r in out] == ["x", "y"]


def test_index_pads_short_columns_and_needs_its_columns(spark, tmp_path):
    folder = tmp_path / "S_SET1_"
    folder.mkdir()
    (folder / f"TABLE_{SENSOR}_SET1.json").write_text(json.dumps({**INDEX, "Duration": [0.5]}))
    out = index_files.read_index_tables(spark, str(folder)).orderBy("table_row").collect()
    assert [r.duration for r in out] == [0.5, None]
    other = tmp_path / "bad"
    other.mkdir()
    (other / "TABLE_X_SET1.json").write_text(json.dumps({"File": ["a", "b"], "Start_Row": [1, 2]}))
    with pytest.raises(Exception, match="no column"):
        index_files.read_index_tables(spark, str(other)).collect()


@pytest.mark.parametrize("change", [{"Start_Time": ["soon", "2022-07-01"]}, {"Start_Row": [None, 3]}, {"End_Row": ["x", 3]}])
def test_index_with_bad_needed_cells_fails(spark, tmp_path, change):
    (tmp_path / f"TABLE_{SENSOR}_SET1.json").write_text(json.dumps({**INDEX, **change}))
    with pytest.raises(Exception, match="unreadable|whole number"):
        index_files.read_index_tables(spark, str(tmp_path)).collect()


def test_files_of_all_shapes_in_one_call(spark, tmp_path):
    """No file and no row is lost, whatever stands beside it."""
    shapes = [INDEX, {"records": rows_of(INDEX)}, {"data": rows_of(INDEX)}, rows_of(INDEX), {k: [v[0]] for k, v in INDEX.items()}]
    shapes += [[INDEX], {**INDEX, "File": "a.json"}, {k: v[0] for k, v in INDEX.items()} | {"More": {"Deep": {"Er": 1}}}, []]
    for i, content in enumerate(shapes):
        (tmp_path / f"TABLE_OLD_S{i}_X_SET1.json").write_text(json.dumps(content))
    found = {}
    for r in index_files.read_index_tables(spark, str(tmp_path)).filter("raw_file IS NOT NULL OR record_uid IS NOT NULL").collect():
        found.setdefault(r.sensor_name, []).append((r.table_row, r.record_uid, r.tag))
    both = [(1, 1, "x"), (2, 2, "y")]
    want = {f"OLD_S{i}_X": both for i in (0, 1, 2, 3, 5, 6)} | {"OLD_S4_X": both[:1], "OLD_S7_X": both[:1]}
    assert {k: sorted(v) for k, v in found.items()} == want


def test_nested_objects_are_flattened():
    assert index_files.json_records({"a": {"b": {"c": 1}, "d": [2]}, "e": 3}, ("data",)) == [{"a.b.c": 1, "a.d": 2, "e": 3}]
    assert index_files.json_records([{"a": [1]}, {"a": [1, 2]}], ()) == [{"a": 1}, {"a": [1, 2]}]


def test_reader_follows_the_rules_for_one_document(spark, tmp_path):
    """Every shape through the reader, which runs no Python, against the plain rules."""
    documents = [
        {"a": {"b": {"c": 1}, "d": [2]}, "e": 3}, {"a": {"b": [1, 2]}, "e": "x"}, {"data": [{"k": 1}, {"k": [1, 2]}]}, {"data": 5, "rows": [[1], "s", None]},
        [], {}, {"a": []}, {"a": [1, 2, 3], "b": ["x"], "c": []}, {"a": [1, None], "b": 7, "c": {}}, [{"a": [1, 2], "b": "[no list"}], [{"a": True, "b": -1.5, "c": "{no"}],
        [{"a": {"b": 1}}, 4, "text", None, [5], [6, 7]], {"records": {"a": 1}}, {"table": [], "x": 1}, [{"é": "ü\n\"q\""}],
    ]
    cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    for i, content in enumerate(documents):
        (tmp_path / f"{i:02d}.json").write_text(" \n" * (i % 2) + json.dumps(content), encoding="utf-8")
    rows = index_files.read_json_rows(spark, str(tmp_path), index_files.INDEX_WRAPPERS)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in rows.collect():
        got.setdefault(int(r._path.split("/")[-1][:2]), []).append((r.row_1based, r.cells))
    for i, content in enumerate(documents):
        want = [{n: cell(v) for n, v in r.items()} for r in index_files.json_records(content, index_files.INDEX_WRAPPERS)]
        assert sorted(got.get(i, []), key=lambda p: p[0]) == list(enumerate(want, 1)), content


@pytest.mark.parametrize("text", ["3", "{\"a\": ", "no json", " "])
def test_no_json_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        index_files.read_json_rows(spark, str(tmp_path), index_files.INDEX_WRAPPERS).collect()


def test_line_records_are_split_and_numbered(spark, tmp_path):
    folder = tmp_path / "SET1" / "A"
    folder.mkdir(parents=True)
    texts = [json.dumps({"timestamp": f"2022-07-01 00:00:{i % 60:02d}", "A": [i]}) for i in range(4000)]
    (folder / "f.json").write_text("\n\n".join(texts) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = index_files.read_waveforms(spark, str(folder), lines=True)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 1
        assert sorted((r.row_1based, r.value) for r in rows.collect()) == [(i + 1, float(i)) for i in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_waveforms_of_many_sensors_in_one_scan(spark, tmp_path):
    for sensor, content in (("A", {"timestamp": ["2022-07-01"], "A": [1]}), ("B", [{"x": 2, "Timestamp": "2022-07-01"}]), ("C", {"rows": [{"timestamp": "2022-07-01", "x": 9, "C": 3}]})):
        (tmp_path / "SET1" / sensor).mkdir(parents=True)
        (tmp_path / "SET1" / sensor / "f.json").write_text(json.dumps(content))
    rows = index_files.read_waveforms(spark, str(tmp_path / "*" / "*")).collect()
    assert sorted((r.set_name, r.sensor_name, r.row_1based, r.value) for r in rows) == [("SET1", "A", 1, 1.0), ("SET1", "B", 1, 2.0), ("SET1", "C", 1, 3.0)]


def test_one_record_by_uid_or_place(spark):
    from spanwave.operators import joins

    at = datetime(2022, 7, 1)
    records = spark.createDataFrame(
        [("S1", "a", "f", 70 + i, i, 3 * i - 2, 3 * i, at, at) for i in (2, 1)],
        "set_name string, sensor_name string, raw_file string, record_uid long, table_row long, start_row_1based long, end_row_1based long, start_time_utc timestamp, end_time_utc timestamp",
    )
    samples = spark.createDataFrame([("S1", "a", "f", i, at, float(i)) for i in range(1, 9)], "set_name string, sensor_name string, raw_file string, row_1based long, timestamp_utc timestamp, value double")
    values = lambda **k: sorted(r.value for r in joins.read_record(records, samples, "a", **k).collect())
    assert values(record_uid=72) == [4.0, 5.0, 6.0] and values() == [1.0, 2.0, 3.0] and values(place=1) == values(record_uid=72)
    for missing in ({"record_uid": 1}, {"place": 2}, {"set_name": "S2"}):
        with pytest.raises(LookupError):
            values(**missing)


@pytest.mark.parametrize("wrapped", [False, True])
def test_waveform_scan(spark, tmp_path, wrapped):
    folder = tmp_path / "SET1" / SENSOR
    folder.mkdir(parents=True)
    columns = {"timestamp": ["2022-07-01 00:00:00.010000", "no time", "2022-07-01 00:00:01"], SENSOR: [1.5, 2, "x"]}
    (folder / "a.json").write_text(json.dumps({"data": rows_of(columns)} if wrapped else columns))
    out = index_files.read_waveforms(spark, str(folder), SENSOR).orderBy("row_1based").collect()
    assert [(r.set_name, r.raw_file, r.row_1based) for r in out] == [("SET1", "a.json", i) for i in (1, 2, 3)]
    assert [r.timestamp_utc for r in out] == [datetime(2022, 7, 1, 0, 0, 0, 10000), None, datetime(2022, 7, 1, 0, 0, 1)]
    assert [r.value for r in out] == [1.5, 2.0, None]


def test_file_names(spark):
    df = spark.createDataFrame([(f"TABLE_{SENSOR}_SET12.json",), (f"TABLE_{SENSOR}.json",)], "f string")
    assert [r[0] for r in df.select(index_files.sensor_from_file(F.col("f"))).collect()] == [SENSOR, SENSOR]


def test_csv_catalogue_and_samples(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "event_id,set_name,deck,active_sensors,excluded_sensors,discarded\ne1,S,OLD,a;;b;,,False\n"
    )
    event = index_files.read_event_csv(spark, str(tmp_path / "e.csv")).first()
    assert event.active_sensors == ["a", "b"] and event.excluded_sensors == [] and event.discarded is False
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("event_id,sample_index,timestamp_utc,a,b\ne1,0,2022-07-01T00:00:00.000Z,1.0,\ne1,1,2022-07-01T00:00:00.010Z,2,3\n")
    long = index_files.read_sample_csv(spark, str(tmp_path / "s.csv.gz"), set_name="S", deck="OLD")
    assert sorted((r.sensor_name, r.sample_index, r.value) for r in long.collect()) == [
        ("a", 0, 1.0), ("a", 1, 2.0), ("b", 1, 3.0)
    ]
    with pytest.raises(FileNotFoundError):
        index_files.read_sensor_map(spark, [str(tmp_path / "none.csv")])
    assert index_files.read_sensor_map(spark, [str(tmp_path / "none.csv"), str(tmp_path / "e.csv")]).count() == 1


def samples(spark):
    rows = [
        (f"{s}__{d}", s, d, n, i, datetime(2022, 7, 1, 0, 0, i, 10000), float(i) if n == "a" else None)
        for s in ("S1", "S2") for d in ("OLD", "NEW") for n in ("a", "b") for i in range(3)
    ]
    return spark.createDataFrame(rows, schema.ALIGNED_SAMPLES)


def test_aligned_samples_round_trip_replaces_partitions(spark, tmp_path):
    path = str(tmp_path / "aligned")
    sinks.write_aligned_samples(samples(spark), path)
    sinks.write_aligned_samples(samples(spark).filter("set_name = 'S1'"), path)
    assert sinks.read_aligned_samples(spark, path).count() == 12
    one = sinks.read_aligned_samples(spark, path, set_name="S2", deck="OLD", sensor_names=["a"], event_ids=["S2__OLD"])
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(set_name" in plan and "EqualTo(sensor_name,a)" in plan


def test_exports(spark, tmp_path):
    sinks.export_samples_csv(samples(spark), ["a", "b"], str(tmp_path / "csv"))
    files = list((tmp_path / "csv" / "set_name=S1" / "deck=OLD").glob("*.csv.gz"))
    assert files and gzip.open(files[0], "rt").readline().strip() == "event_id,sample_index,timestamp_utc,a,b"
    sinks.export_event_csv(samples(spark), "S1__OLD", ["b", "a"], str(tmp_path / "one"))
    text = next((tmp_path / "one").glob("*.csv")).read_text().splitlines()
    assert text[:2] == ["timestamp_utc,b,a", '2022-07-01T00:00:00.010Z,,0.0']
    sinks.write_tables({"t": samples(spark)}, str(tmp_path / "json"), form="json")
    assert spark.read.json(str(tmp_path / "json" / "t")).count() == 24


def test_stage_tables_and_feature_tables(spark, tmp_path):
    found = spark.createDataFrame([("e", "S", "OLD", True)], "event_id string, set_name string, deck string, discarded boolean")
    bridge = spark.createDataFrame([("e", "S", "OLD", "a")], "event_id string, set_name string, deck string, sensor_name string")
    sinks.write_set(str(tmp_path), records=bridge, found=found, event_sensors=bridge)
    assert spark.read.parquet(str(tmp_path / "events")).first().discarded is True
    table = spark.createDataFrame([("S", "OLD", "e", 1, "f", 2, "a")], "set_name string, deck string, event_id string, sensor_order int, feature_family string, peak_rank int, sensor_name string")
    names = ["sensor_event_features", "deck_modal_peaks", "deck_mode_shape_components", "feature_family_status"]
    sinks.write_tables({n: table for n in names}, str(tmp_path / "features"))
    assert all(t.count() == 1 for t in sinks.read_feature_tables(spark, str(tmp_path / "features")).values())


def test_sensor_upsert_keeps_stored_rows(spark, tmp_path):
    path = str(tmp_path / "sensors")
    first = spark.createDataFrame([("a", "OLD")], "sensor_name string, deck string")
    sinks.append_new_sensors(schema.conform(first, schema.SENSORS), path)
    more = spark.createDataFrame([("a", "NEW"), ("b", "NEW"), ("b", "NEW")], "sensor_name string, deck string")
    sinks.append_new_sensors(schema.conform(more, schema.SENSORS), path)
    assert sorted((r.sensor_name, r.deck) for r in spark.read.parquet(path).collect()) == [("a", "OLD"), ("b", "NEW")]


def test_incremental_run_skips_processed_events(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        query = resume.process_new_events(
            spark, source, frame.schema, sink, mark, lambda df: df.withColumn("done", F.lit(1))
        )
        query.awaitTermination()

    frame = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    frame.write.parquet(source)
    run()
    frame.unionByName(spark.createDataFrame([("e3",)], "event_id string")).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == ["e1", "e2", "e3"]


def test_half_a_batch_is_not_done(spark, tmp_path, monkeypatch):
    """A run that fails before or after its rows are written leaves nothing behind that counts."""
    from spanwave.sinks.ledger import Ledger

    path = str(tmp_path / "out")
    found = lambda *ids: spark.createDataFrame([(i, k) for i in ids for k in range(2)], "event_id string, k int")
    assert sinks.append_unprocessed(found("a", "b"), lambda df: df, path) == 2
    broken = lambda df: df.withColumn("k", F.when(F.col("event_id") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("k")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_unprocessed(found("b", "c", "d").repartition(4), broken, path)
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "commit", lambda self, batch: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.append_unprocessed(found("b", "c", "d"), lambda df: df, path)
    held = lambda: sorted((r.event_id, r.k) for r in Ledger(spark, path).read().collect())
    assert held() == [(i, k) for i in "ab" for k in range(2)]
    assert sinks.append_unprocessed(found("b", "c", "d"), lambda df: df, path) == 2
    assert sinks.append_unprocessed(found("a", "d"), lambda df: df, path) == 0
    assert held() == [(i, k) for i in "abcd" for k in range(2)]
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == sorted("aabbccdd")


def test_ledger_adopts_a_table_without_one(spark, tmp_path):
    from spanwave.sinks.ledger import Ledger

    path = str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",)], "event_id string").write.parquet(path)
    more = spark.createDataFrame([("b",), ("c",)], "event_id string")
    assert sinks.append_unprocessed(more, lambda df: df, path) == 1
    assert sorted(r.event_id for r in Ledger(spark, path).read().collect()) == ["a", "b", "c"]
