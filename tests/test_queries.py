"""Registered queries against their SQL on the smallest data set."""

import os

import duckdb
import pytest

from spanwave.plans import catalog
from tests import compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "event_sensor_rows", "record_samples", "preprocess_summary", "asof_reference_index", "zeroed_waveforms",
    "waveform_features", "point_anomalies", "status_bands", "metric_correlations", "reference_threshold",
    "set_comparison", "packaging_gate", "scaled_values", "duplicate_channels", "related_sensors",
]
NAMES = sorted(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("test data absent")
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert compare.difference(got, duck.execute(catalog.ORACLES[name]).df()) is None


SPLIT_SIZES = (1, 2, 5, 9, 61, 738, 10256)


@pytest.fixture(scope="module")
def split_folders(duck, tmp_path_factory):
    """Event tables whose shares leave one or two events, ties among them."""
    root = tmp_path_factory.mktemp("splits")
    for n in SPLIT_SIZES:
        (root / str(n)).mkdir()
        duck.execute(
            "COPY (SELECT i AS vec_id, [0.5::FLOAT] AS embedding, (i % 10)::INTEGER AS label "
            f"FROM range({n}) AS t(i)) TO '{root}/{n}/embeddings.parquet' (FORMAT parquet)"
        )
    return root


@pytest.mark.parametrize("name", ["event_split", "split_manifest"])
def test_splits_match_sql_with_remainders(spark, split_folders, name):
    for n in SPLIT_SIZES:
        folder = f"{split_folders}/{n}"
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
            want = con.execute(catalog.ORACLES[name]).df()
        got = catalog.QUERIES[name](spark, folder).toPandas()
        assert compare.difference(got, want) is None, n
