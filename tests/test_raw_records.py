"""How the decomposition of raw records reads its samples."""

import os

import pytest
from pyspark.sql import functions as F

from spanwave.operators import joins, modal, sequence
from spanwave.plans import catalog, feature_queries, features
from tests import compare

FOLDER = "/root/testdata/sf0.001"


def test_samples_are_read_once(spark, monkeypatch):
    """One read serves the index and the samples of both decks, and only the wanted channels are numbered."""
    if not os.path.isdir(FOLDER):
        pytest.skip("test data absent")
    tables, read, sliced = feature_queries.tables, [], []
    readings, slice_records = tables.readings, joins.slice_records

    def counted(*args):
        read.append(args)
        return readings(*args)

    def watched(records, samples, **options):
        sliced.append({r.sensor_name for r in samples.select("sensor_name").distinct().collect()})
        return slice_records(records, samples, **options)

    monkeypatch.setattr(tables, "readings", counted)
    monkeypatch.setattr(features.joins, "slice_records", watched)
    got = catalog.QUERIES["raw_record_decomposition"](spark, FOLDER).toPandas()
    assert len(read) == 1
    assert [{name.split("_", 1)[0] for name in names} for names in sliced] == [{"NEW"}, {"OLD"}]
    assert all(name.endswith("_ACC_Z") for names in sliced for name in names)
    with compare.connect(FOLDER) as con:
        want = con.execute(catalog.ORACLES["raw_record_decomposition"]).df()
    assert compare.difference(got, want) is None


def test_few_rows_stay_in_their_tasks(spark):
    """Rows that would fit a broadcast are still numbered and kept by tile."""
    rows = spark.range(400).select((F.col("id") % 4).alias("k"), "id", F.floor(F.col("id") / 100).alias("tile"))
    done = sequence.ordinal(rows, ["k"], ["id"], "tile", "row", size="n", in_place=True)
    assert {(r.k, r.id, r.row, r.n) for r in done.collect()} == {(i % 4, i, i // 4, 100) for i in range(400)}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_segments_are_transformed_in_bulk(spark, monkeypatch):
    """Segments of two lengths and counts in one batch, more than fit at once, each with its own weight."""
    import numpy as np

    monkeypatch.setattr(modal, "VALUES_AT_ONCE", 40)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for deck, length in (("NEW", 8), ("OLD", 6)):
        for event, count in (("a", 3), ("b", 1)):
            for segment in range(count):
                x = rng.normal(size=(length, 2))
                rows.append(("S", deck, f"{deck}{event}", segment, length, count, 2, x.tolist()))
                window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
                z = np.fft.rfft(x.T * window, axis=1) / window.sum()
                part = np.einsum("if,jf->fij", z, z.conj()) / (count * 2)
                want[deck] = want.get(deck, 0) + part
    segmented = spark.createDataFrame(
        rows,
        "set_name string, deck string, event_id string, segment bigint, segment_length bigint, segment_count bigint, "
        "event_count bigint, x array<array<double>>",
    ).coalesce(1)
    for r in modal.spectral_density(segmented).collect():
        cell = want[r.deck][r.frequency_index, r.channel_i, r.channel_j]
        assert abs(complex(r.re, r.im) - cell) < 1e-12
