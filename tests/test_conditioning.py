import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwave.operators import conditioning
from tests import reference_kernels


def test_filter_gain():
    s = conditioning.butterworth_sections(4, 0.5, 20.0, 100.0)
    assert conditioning.pad_length(s) == 27

    def gain(hz):
        z = np.exp(2j * np.pi * hz / 100)
        return np.prod([abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)) for b0, b1, b2, _, a1, a2 in s])

    assert gain(0.5) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    assert gain(20.0) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    assert gain(5.0) == pytest.approx(1.0, abs=1e-3)
    assert gain(1e-6) < 1e-6


@pytest.mark.parametrize("low, high", [(0, 20), (0.5, 50), (20, 5)])
def test_band_errors(low, high):
    with pytest.raises(ValueError):
        conditioning.butterworth_sections(4, low, high, 100.0)


@pytest.mark.parametrize("low, block", [(0.5, 65536), (8.0, 512), (8.0, 700)])
def test_blocked_filter_equals_one_piece(spark, low, block):
    rng = np.random.default_rng(3)
    waves = {f"w{n}": rng.normal(size=n).cumsum() for n in (5, 27, 28, 64, 511, 512, 513, 1024, 1300, 2900)}
    rows = [(k, i, float(v)) for k, w in waves.items() for i, v in enumerate(w)]
    df = spark.createDataFrame(rows, "sensor_name string, sample_index bigint, value double")
    sections = conditioning.butterworth_sections(4, low, 20.0, 100.0)
    assert conditioning.halo_length(sections) <= block
    out = conditioning.bandpass(df, ["sensor_name"], low_hz=low, block=block).toPandas()
    for name, wave in waves.items():
        got = out[out.sensor_name == name].sort_values("sample_index")
        assert got.sample_index.tolist() == list(range(len(wave)))
        want = reference_kernels.filter_both_ways(sections, wave, 27)
        assert np.allclose(got["value"].to_numpy(), want, atol=1e-9)


def test_zeroing_and_chain(spark):
    rows = [("NEW_S1_DO_INF_STR", i, v) for i, v in enumerate([10.0, 21.0, 30.0, 40.0])]
    rows += [("NEW_S1_DO_SUP_STR", 0, 9.0), ("NEW_S1_DO_MID_ACC_Y", 0, 3.0), ("NEW_S1_DO_MID_ACC_Y", 1, 4.0)]
    rows += [("NEW_S1_DO_MID_ACC_Z", i, v) for i, v in enumerate([1.0, float("nan"), 3.0])]
    df = spark.createDataFrame(rows, "sensor_name string, sample_index bigint, value double")
    out = conditioning.condition(df, ["sensor_name"]).orderBy("sensor_name", "sample_index")
    got = {}
    for r in out.collect():
        got.setdefault(r.sensor_name, []).append(round(r.value, 9))
    assert got["NEW_S1_DO_INF_STR"] == [0.0, 1.0, 0.0, 0.0]
    assert got["NEW_S1_DO_SUP_STR"] == [0.0]
    assert got["NEW_S1_DO_MID_ACC_Y"] == [3.0, 4.0]
    assert got["NEW_S1_DO_MID_ACC_Z"] == [0.0, -2.0, 0.0]
    with pytest.raises(ValueError):
        conditioning.zero_waveforms(df, ["sensor_name"], method="cubic")
