"""End to end over a small synthetic month: preprocess, features, model inputs, bundle."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwave.operators import conditioning, events
from spanwave.plans import bundle, features, preprocess, training
from spanwave.session import cut_lineage
from tests import reference_kernels

SENSORS = [f"OLD_S{s}_DO_{k}" for s in (1, 2) for k in ("INF_STR", "SUP_STR", "MID_ACC_Z", "SHE_STR")]
EVENTS, ROWS, RATE = 3, 600, 100
START = datetime(2022, 7, 1)


def wave(event: int, sensor: int) -> np.ndarray:
    t = np.arange(ROWS) / RATE
    rng = np.random.default_rng(event * 100 + sensor)
    return (1 + sensor) * np.sin(2 * np.pi * 3 * t) + 0.05 * rng.normal(size=ROWS) + 0.2 * t


@pytest.fixture(scope="module")
def month(spark):
    rows = []
    for s, name in enumerate(SENSORS):
        for e in range(EVENTS):
            if e == 2 and s == 5:
                continue  # one event lacks a sensor
            rows.append((name, e, wave(e, s).tolist()))
    base = spark.createDataFrame(rows, "sensor_name string, e int, w array<double>")
    i = F.col("i")
    clock = F.timestamp_micros(F.lit(int(START.timestamp() * 1e6)) + F.col("e") * 3_600_000_000 + i * 10_000)
    samples = cut_lineage(
        base.select("sensor_name", "e", F.posexplode("w").alias("i", "value")).select(
            F.lit("SPAN_SET1_2022_07").alias("set_name"),
            "sensor_name",
            F.concat("sensor_name", F.lit(".json")).alias("raw_file"),
            (F.col("e") * ROWS + i + 1).cast("bigint").alias("row_1based"),
            clock.alias("timestamp_utc"),
            "value",
            "e",
        )
    )
    records = cut_lineage(
        samples.groupBy("set_name", "sensor_name", "raw_file", "e").agg(
            F.min("row_1based").alias("start_row_1based"),
            F.max("row_1based").alias("end_row_1based"),
            F.min("timestamp_utc").alias("start_time_utc"),
            F.max("timestamp_utc").alias("end_time_utc"),
            F.min_by("value", "row_1based").alias("start_value"),
            F.max_by("value", "row_1based").alias("end_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.avg("value").alias("mean_value"),
        ).withColumns(
            {
                "deck": F.lit("OLD"),
                "record_uid": (F.col("e") + 1).cast("bigint"),
                "duration": F.lit((ROWS - 1) / RATE),
                "diff_value": F.col("end_value") - F.col("start_value"),
                "range_value": F.col("max_value") - F.col("min_value"),
                "temperature": F.lit(20.0) + F.col("e"),
            }
        )
    )
    return records, samples.drop("e")


@pytest.fixture(scope="module")
def done(spark, month):
    result = preprocess.Run(*month, preprocess.Settings(min_active_sensors=2, tile_seconds=2))
    return {
        "events": cut_lineage(result.events),
        "event_sensors": cut_lineage(result.event_sensors),
        "aligned_samples": cut_lineage(result.aligned_samples),
        "summary": result.summary,
    }


def test_preprocess_keeps_every_row_and_conditions_each_signal(done):
    found = done["events"].orderBy("start_time_utc").collect()
    assert [(r.active_sensor_count, r.rows_before_alignment, r.rows_after_alignment, r.discarded) for r in found] == [
        (6, ROWS, ROWS, False), (6, ROWS, ROWS, False), (5, ROWS, ROWS, False)
    ]
    assert found[0].excluded_sensors == ["OLD_S1_DO_SHE_STR", "OLD_S2_DO_SHE_STR"]
    assert found[0].reference_sensor == "OLD_S1_DO_INF_STR"
    rows = done["aligned_samples"].filter(F.col("event_id") == found[0].event_id).toPandas()
    sections = conditioning.butterworth_sections(4, 0.5, 20.0, 100.0)
    for s, name in enumerate(SENSORS):
        got = rows[rows.sensor_name == name].sort_values("sample_index")["value"].to_numpy()
        if "SHE" in name:
            assert len(got) == 0
            continue
        want = wave(0, s)
        if "ACC" in name:
            want = reference_kernels.filter_both_ways(sections, want, 27)
        want = want - np.linspace(want[0], want[-1], ROWS)
        assert np.allclose(got, want, atol=1e-9)
    summary = {(r.section, r.name): r["count"] for r in done["summary"].collect()}
    assert summary["total", "events"] == 3 and summary["deck_retained", "OLD"] == 3


def test_features_and_modal_tables(done):
    tables = features.build(
        done["events"], done["event_sensors"], done["aligned_samples"],
        features.Settings(nperseg=256, noverlap=128, tile_seconds=2),
    )
    rows = tables["sensor_event_features"]
    assert rows.count() == 17 and rows.filter("sample_count = 600").count() == 17
    status = tables["feature_family_status"].first()
    assert (status.status, status.detail, status.channel_count) == ("completed", "computed from 3 retained events", 2)
    peaks = tables["deck_modal_peaks"].toPandas()
    assert abs(peaks["frequency_hz"] - 3).min() < 0.3
    assert tables["deck_mode_shape_components"].count() == 2 * len(peaks)
    off = features.build(done["events"], done["event_sensors"], done["aligned_samples"], features.Settings(modal_enabled=False))
    assert off["feature_family_status"].first().detail == "disabled in config"


def test_model_inputs(done, month):
    sensors = events.add_sensor_order(month[0]).select("sensor_name", "deck", "sensor_order")
    inputs = training.package(
        done["events"], done["event_sensors"], done["aligned_samples"], sensors,
        training.Settings(half_window=50, min_aligned_samples=500),
    )
    tally = inputs["summary"].first()
    assert (tally.retained_events, tally.complete_events, tally.packaged_events) == (3, 2, 2)
    strain = inputs["strain_inputs"].toPandas()
    acc = inputs["acc_inputs"].toPandas()
    bins = inputs["frequency_bins"].count()
    assert len(strain) == 2 * 4 and set(strain["values"].map(len)) == {100}
    assert len(acc) == 2 * 2 and set(acc["values"].map(len)) == {bins} and bins == 118
    assert [r.row_index for r in inputs["manifest"].orderBy("row_index").collect()] == [0, 1]
    assert inputs["temperature_inputs"].orderBy("event_id").first().temperature_sensor_count == 6
    ready = training.prepare(inputs, fractions=(0.5, 0.5, 0.0))
    assert {r.split: r.event_count for r in ready["split_manifest"].collect()} == {"train": 1, "validation": 1}
    train = ready["splits"].filter("split = 'train'").first().event_id
    mine = strain[(strain.event_id == train) & (strain.model_channel_index == 0)]["values"].iloc[0]
    fitted = ready["strain_scaling"].filter("model_channel_index = 0").first()
    assert fitted["mean"] == pytest.approx(np.mean(mine)) and fitted["std"] == pytest.approx(np.std(mine))
    assert ready["temperature_scaling"].first()["std"] == 1.0


def test_model_inputs_of_every_deck(done, month):
    """One run over all decks equals a run a deck; each deck numbers its own channels."""
    sensors = events.add_sensor_order(month[0]).select("sensor_name", "deck", "sensor_order")
    other = sensors.withColumns({"sensor_name": F.regexp_replace("sensor_name", "^OLD", "NEW"), "deck": F.lit("NEW")})
    tables = [done[n] for n in ("events", "event_sensors", "aligned_samples")]
    settings = training.Settings(half_window=50, min_aligned_samples=500)
    both = training.package_decks(*tables, sensors.union(other), settings)
    assert {(r.deck, r.n) for r in both["sensor_map"].groupBy("deck").agg(F.max("model_channel_index").alias("n")).collect()} == {("NEW", 3), ("OLD", 3)}
    alone = training.package(*tables, sensors, settings)
    assert {r.event_id for r in both["manifest"].collect()} == {r.event_id for r in alone["manifest"].collect()}
    assert {r.deck: r.packaged_events for r in both["summary"].collect()} == {"NEW": 0, "OLD": 2}


def test_samples_are_dealt_once(month):
    """Alignment reads the bucketed stage table; only summaries a tile are shuffled after it."""
    import re

    from spanwave.operators import align

    run = preprocess.Run(*month, preprocess.Settings(acc_filter="none"), slots=8)
    plan = align.align(run.conditioned, 8)._jdf.queryExecution().executedPlan().toString()
    assert "default.stage_" in plan
    below = re.findall(r"Exchange hashpartitioning\((.*?)\).*\n.*?(\w+Aggregate|Generate|Project|Scan)", plan)
    assert below and all("tile" not in keys for keys, _ in below)


def test_events_are_loaded_by_request(spark, month):
    from spanwave.operators import joins

    records, samples = month
    found = events.assign_event_groups(events.add_sensor_order(records), "shared_start")
    named = events.group_events(found).withColumn("request_id", F.col("event_id"))
    asked = named.select("request_id", "event_id", "deck", "start_time_utc", "end_time_utc", "active_sensor_count", F.array(F.lit(SENSORS[0]), F.lit(SENSORS[5])).alias("sensors"))
    clock = F.when(F.col("row_1based") % 100 != 1, F.col("timestamp_utc"))
    table, rows = joins.load_events(found, asked, samples.withColumn("timestamp_utc", clock))
    got = sorted((r.sensor_name, r.row_count, r.dropped_rows) for r in table.collect())
    assert got == [(SENSORS[0], 594, 6)] * 3 + [(SENSORS[5], 594, 6)] * 2
    assert rows.count() == 594 * 5


def test_bundle(month):
    tables = bundle.build(*month)
    assert tables["sensor_layout"].count() == 8 and tables["event_groups"].count() == 3
    assert tables["sensor_metrics"].filter("metric_id = 'event_count'").count() == 8
    waves = tables["waveforms"].groupBy("sensor_name", "start_time").agg(F.count("*").alias("n"), F.max("sample_index").alias("m")).collect()
    assert len(waves) == 16 and all(r.n in (200, 201) and r.m == ROWS - 1 for r in waves)
