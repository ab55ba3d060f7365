import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwave.functions import numbers
from spanwave.operators import features, modal, overview, scoring, sequence, tensors


def test_quantiles_match_numpy_under_skew(spark):
    rng = np.random.default_rng(1)
    groups = {
        "hot": np.concatenate([rng.lognormal(0, 3, 4000), [1e9, 1e9]]),
        "flat": np.full(50, 2.5),
        "ties": rng.integers(0, 4, 999).astype(float),
        "one": np.array([7.0]),
        "negative": -rng.exponential(5, 301),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = [0.0, 0.2, 0.5, 0.99, 1.0]
    got = {(r.g, r.probability): r.quantile for r in sequence.quantiles(df, ["g"], "v", wanted, bins=64).collect()}
    assert len(got) == len(groups) * len(wanted)
    for name, values in groups.items():
        for p in wanted:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    whole = sequence.quantiles(df, [], "v", [0.75]).first().quantile
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.75), rel=1e-12)


def test_ordinal_and_trailing_over_tiles(spark):
    rows = [("hot", i, float((i * 7) % 13)) for i in range(500)] + [("cold", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, t bigint, v double").repartition(5)
    numbered = sequence.ordinal(df.withColumn("tile", F.floor(F.col("t") / 32)), ["g"], ["t"], "tile", "n", size="size")
    assert all(r.n == r.t and r["size"] == (500 if r.g == "hot" else 5) for r in numbered.collect())
    out = sequence.trailing(numbered, ["g"], "n", 10, {"m": F.avg("v"), "s": F.stddev_samp("v")}, span=64)
    hot = out.filter("g = 'hot'").orderBy("n").toPandas()
    series = pd.Series([r[2] for r in rows[:500]])
    want = series.rolling(10).mean().shift(1)
    assert len(hot) == 500 and hot["m"].isna().sum() == 10
    assert np.allclose(hot["m"], want, equal_nan=True)
    assert np.allclose(hot["s"], series.rolling(10).std().shift(1), equal_nan=True)


@pytest.mark.parametrize("tile", [3, 1000])
def test_waveform_statistics_match_pandas(spark, tile):
    rng = np.random.default_rng(5)
    waves = {"a": rng.normal(size=40), "b": np.array([1.0, 0.0, -1.0, 2.0]), "c": np.full(6, 3.0), "d": np.array([-2.0]), "e": np.array([1.0, -1.0])}
    rows = [("ev", k, i, (pd.Timestamp("2022-07-01") + pd.Timedelta(seconds=i)).to_pydatetime(), float(v)) for k, w in waves.items() for i, v in enumerate(w)]
    rows.append(("ev", "a", 40, pd.Timestamp("2022-07-02").to_pydatetime(), float("nan")))
    df = spark.createDataFrame(rows, "event_id string, sensor_name string, sample_index bigint, timestamp_utc timestamp, value double")
    df = df.withColumn("tile", F.floor(F.col("sample_index") / tile))
    out = features.waveform_statistics(df, ["event_id", "sensor_name"]).toPandas().set_index("sensor_name")
    for name, wave in waves.items():
        s, r = pd.Series(wave), out.loc[name]
        signs = np.sign(wave)
        rate = float((signs[1:] * signs[:-1] < 0).sum() / (len(wave) - 1)) if len(wave) > 1 else 0.0
        want = {
            "sample_count": len(wave), "aligned_duration_s": len(wave) - 1, "mean": s.mean(), "std": s.std(),
            "rms": np.sqrt((s**2).mean()), "energy": (s**2).sum(), "peak_to_peak": s.max() - s.min(),
            "crest_factor": s.abs().max() / np.sqrt((s**2).mean()), "zero_crossing_rate": rate,
            "skewness": s.skew(), "kurtosis": s.kurt(),
        }
        for column, value in want.items():
            got = np.nan if r[column] is None else float(r[column])
            assert got == pytest.approx(value, rel=1e-9, abs=1e-9, nan_ok=True), (name, column)


def test_peak_window(spark):
    cases = [(5, 12, 2), (0, 12, 2), (11, 12, 2), (1, 3, 2)]
    got = []
    for peak, n, half in cases:
        start, stop = tensors.peak_window(F.lit(peak), F.lit(n), half)
        got.append(tuple(spark.range(1).select(start, stop).first()))
    assert got == [(3, 7), (0, 4), (8, 12), (None, None)]


def test_split_counts():
    assert tensors.split_counts(10, (0.7, 0.2, 0.1)) == [7, 2, 1]
    assert tensors.split_counts(1, (0.0, 0.5, 0.5)) == [1, 0, 0]
    assert sum(tensors.split_counts(13, (0.7, 0.2, 0.1))) == 13
    with pytest.raises(ValueError):
        tensors.split_counts(3, (0.5, 0.2, 0.1))
    with pytest.raises(ValueError):
        tensors.check_fractions((1.2, -0.2))


def test_split_is_disjoint_and_repeatable(spark):
    events = spark.range(10).select(F.concat(F.lit("e"), "id").alias("event_id"))
    first = {r.event_id: r.split for r in tensors.split_events(events).collect()}
    again = {r.event_id: r.split for r in tensors.split_events(events.repartition(7)).collect()}
    assert first == again and sorted(first.values()).count("train") == 7 and list(first.values()).count("test") == 1


def test_spectra_match_numpy(spark):
    rng = np.random.default_rng(2)
    waves = {"a": rng.normal(size=100), "b": rng.normal(size=37)}
    rows = [(k, i, float(np.float32(v))) for k, w in waves.items() for i, v in enumerate(w)]
    df = spark.createDataFrame(rows, "k string, sample_index bigint, value double")
    bins = np.fft.rfftfreq(100, 0.01)
    keep = (bins >= 0.5) & (bins <= 20)
    for block in (16, 16384):
        out = tensors.spectra(df, ["k"], 100, block=block).toPandas()
        for name, wave in waves.items():
            got = out[out.k == name].sort_values("bin")
            want = np.abs(np.fft.rfft(wave.astype(np.float32).astype(float), n=100))[keep]
            assert np.allclose(got["magnitude"], want, atol=1e-9) and got["bin"].tolist() == np.flatnonzero(keep).tolist()


def fdd_samples(spark, hz, channels, events=2, seconds=40, second=None):
    t = np.arange(int(seconds * 100)) / 100
    rng = np.random.default_rng(0)
    rows = []
    for e in range(events):
        for c in range(channels):
            wave = (c + 1) * np.sin(2 * np.pi * hz * t) + 0.01 * rng.normal(size=len(t))
            if second:
                wave = wave + 0.15 * np.sin(2 * np.pi * second * t + c)
            rows.append((f"e{e}", f"NEW_S1_DO_P{c}_ACC_Z", wave.tolist()))
    wide = spark.createDataFrame(rows, "event_id string, sensor_name string, w array<double>")
    return wide.select(
        F.lit("S").alias("set_name"), F.lit("NEW").alias("deck"), "event_id", "sensor_name",
        F.posexplode("w").alias("sample_index", "value"),
    ).withColumn("tile", F.floor(F.col("sample_index") / 500))


def test_report_names_what_is_left_out(spark):
    rows = [("e1", i, float(i)) for i in range(9)] + [("e2", i, float(i)) for i in range(3)]
    matrices = spark.createDataFrame(rows, "event_id string, row long, v double").selectExpr(
        "'S' AS set_name", "'NEW' AS deck", "event_id", "row", "count(*) OVER (PARTITION BY event_id) AS row_count"
    )
    selected = spark.createDataFrame([("S", "NEW", e) for e in ("e1", "e2", "e3")], "set_name string, deck string, event_id string")
    report = lambda least: {r.event_id: (r.row_count, r.reason) for r in modal.matrix_report(selected, matrices, min_rows=least).collect()}
    assert report(2) == {"e1": (9, None), "e2": (3, None), "e3": (0, "no_full_rows")}
    assert report(5) == {"e1": (9, "too_few_events"), "e2": (3, "too_few_rows"), "e3": (0, "no_full_rows")}


def test_decomposition_finds_the_mode(spark):
    samples = fdd_samples(spark, 3.2, 4, second=11.0)
    bridge = samples.select("set_name", "deck", "event_id", "sensor_name").distinct().withColumns(
        {"sensor_status": F.lit("included"), "start_time_utc": F.col("event_id")}
    )
    selected = modal.first_events(modal.candidate_events(modal.channels_of(bridge)), 5)
    channels = modal.common_channels(selected)
    matrices = modal.event_matrices(samples, selected, channels)
    peaks, located = modal.run(matrices, channels, n_peaks=3)
    table = peaks.toPandas()
    assert min(abs(table["frequency_hz"] - 3.2)) < 0.3 and table["peak_rank"].tolist() == sorted(table["peak_rank"])
    shapes = located.toPandas()
    for _, peak in shapes.groupby("peak_rank"):
        assert peak["mode_shape_amplitude"].max() == pytest.approx(1.0)
        assert peak["mode_shape_signed_component"].abs().max() == pytest.approx(1.0)
    top = shapes[(shapes["frequency_hz"] - 3.2).abs() < 0.3].sort_values("sensor_name")
    first = top[top.peak_rank == top.peak_rank.min()]
    assert np.allclose(first["mode_shape_amplitude"], [0.25, 0.5, 0.75, 1.0], atol=0.02)

    # Against numpy: same segments, window and average.
    x = np.stack([np.array(r.w) for r in samples.groupBy("event_id", "sensor_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "value"))), lambda s: s["value"]).alias("w")).orderBy("event_id", "sensor_name").collect()]).reshape(2, 4, -1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1024)
    density = 0
    for event in x:
        z = np.stack([np.fft.rfft(event[:, s : s + 1024] * window) / window.sum() for s in range(0, 4000 - 1023, 512)])
        density = density + np.einsum("sif,sjf->fij", z, z.conj()) / len(z) / 2
    want = np.linalg.eigvalsh(density)[:, -1]
    got = modal.first_curve(modal.decompose(modal.spectral_density(modal.segments(matrices)))).orderBy("frequency_index").toPandas()
    assert np.allclose(got["singular_value"], want, atol=1e-12)


def test_flat_topped_peak_and_fallback(spark):
    curves = {"flat": [0, 1, 3, 3, 3, 1, 2, 0], "rising": [1, 2, 3, 3], "one": [5]}
    rows = [(k, i, float(v)) for k, c in curves.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {}
    for r in modal.local_maxima(df, ["g"], "i", "v").orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.i)
    assert got == {"flat": [3, 6], "rising": [2], "one": [0]}


def test_constant_series_have_no_correlation(spark):
    rows = [(f"SPAN_SET{i}_x", n, v) for n, vs in {"OLD_S1_DO_INF_STR": [1, 2, 3], "NEW_S1_DO_INF_STR": [2, 4, 6], "OLD_S1_DO_SUP_STR": [5, 5, 5]}.items() for i, v in enumerate(vs)]
    long = spark.createDataFrame([(s, n, "m", float(v)) for s, n, v in rows], "set_name string, sensor_name string, metric_id string, value double")
    out = overview.correlations(long, overview.sensor_layout(long)).collect()
    assert {(r.sensor_name, r.target_sensor, r.correlation, r.cross_deck_homologous) for r in out} == {
        ("OLD_S1_DO_INF_STR", "NEW_S1_DO_INF_STR", 1.0, True), ("NEW_S1_DO_INF_STR", "OLD_S1_DO_INF_STR", 1.0, True)
    }


def test_low_rank_reconstruction_matches_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 6)) + 0.05 * rng.normal(size=(60, 6))
    df = spark.createDataFrame([(f"e{i}", "R" if i < 40 else "O", r.tolist()) for i, r in enumerate(x)], "event_id string, set_name string, values array<double>")
    centred = scoring.centre(df, F.col("set_name") == "R", 6)
    model = scoring.fit_projection(centred.filter("set_name = 'R'"), 2)
    out = scoring.reconstruct(model, scoring.project(model, centred)).toPandas().set_index("event_id")
    base = x[:40].mean(axis=0)
    axes = np.linalg.svd(x[:40] - base)[2][:2]
    for i in range(60):
        assert np.allclose(out.loc[f"e{i}", "reconstruction"], (x[i] - base) @ axes.T @ axes, atol=1e-9)


def test_complex_helpers(spark):
    z, w = 3 - 4j, 1 + 2j
    re, im = numbers.rotate(F.lit(z.real), F.lit(z.imag), F.lit(0.3))
    a, b = numbers.times_conjugate(F.lit(z.real), F.lit(z.imag), F.lit(w.real), F.lit(w.imag))
    row = spark.range(1).select(re.alias("re"), im.alias("im"), a.alias("a"), b.alias("b"), numbers.round_half_even(F.lit(0.5), 0).alias("r")).first()
    assert complex(row.re, row.im) == pytest.approx(z * np.exp(-0.3j)) and complex(row.a, row.b) == z * w.conjugate() and row.r == 0
    with pytest.raises(Exception, match="no whole number in Start_Row"):
        spark.range(1).select(numbers.to_int(F.lit(float("nan")), "Start_Row")).collect()


def test_quantiles_of_repeated_values(spark):
    """A value that fills a group is one row of its bin; ranks on both sides of it are right."""
    from spanwave.operators import sequence

    rows = [("a", 5.0)] * 5000 + [("a", 1.0), ("a", 9.0)] + [("b", float(i % 3)) for i in range(1000)] + [("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    chances = [0.0, 0.1, 0.5, 0.75, 0.9999, 1.0]
    got = {(r.g, r.probability): r.quantile for r in sequence.quantiles(df, ["g"], "v", chances).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g]
        for p in chances:
            assert got[g, p] == pytest.approx(np.quantile(values, p))


def test_quantiles_between_pivots(spark):
    """Whatever the summary's error, the wanted ranks lie between its pivots."""
    rng = np.random.default_rng(8)
    groups = {"even": np.arange(3000.0), "steps": np.floor(np.arange(3000) / 700), "wild": rng.standard_cauchy(3000), "few": rng.normal(size=39)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in rng.permutation(vs)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    chances = [0.0, 0.05, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    for bins in (4, 10, 300):
        got = {(r.g, r.probability): r.quantile for r in sequence.quantiles(df, ["g"], "v", chances, bins=bins).collect()}
        assert got == {(g, p): pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12) for g, v in groups.items() for p in chances}
    assert sequence.quantiles(df.filter("g = 'none'"), [], "v", [0.5]).collect() == []


def test_channel_errors_match_numpy(spark):
    values = np.random.default_rng(3).normal(size=(5, 4 * 700))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "i int, v array<double>")
    got = df.select("i", scoring.channel_errors(F.col("v"), 4).alias("e")).collect()
    for r in got:
        assert r.e == pytest.approx(values[r.i].reshape(4, 700).var(axis=1).tolist(), rel=1e-12)


@pytest.mark.parametrize("n", [1, 7, 1000, 131_071])
def test_long_transform_matches_numpy(spark, n):
    """Any length, two waveforms at once, one of them short and padded."""
    from spanwave.operators import transform

    rng = np.random.default_rng(n)
    waves = {"a": rng.normal(size=n), "b": rng.normal(size=max(1, n // 3))}
    rows = [(k, w.tolist()) for k, w in waves.items()]
    df = spark.createDataFrame(rows, "k string, w array<double>").select("k", F.posexplode("w").alias("sample_index", "value"))
    low, high = n // 10, n // 2
    out = transform.long_transform(df, ["k"], n, low, high).toPandas()
    for name, wave in waves.items():
        got = out[out.k == name].sort_values("bin")
        assert got["bin"].tolist() == list(range(low, high + 1))
        assert np.allclose(got["magnitude"], np.abs(np.fft.fft(wave, n=n))[low : high + 1], rtol=1e-9, atol=1e-9 * np.sqrt(n))
