"""Signal conditioning: endpoint baseline removal and zero-phase band-pass filtering.

The filter is recursive over a whole waveform, but forgets: after a fixed number of samples the
effect of earlier input is below double precision. Waveforms are cut into blocks of bounded length,
each block takes that many neighbouring samples along on both sides, and the blocks are filtered
independently. Only the true ends of a waveform get the odd extension and the steady-state start.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import naming

ZEROING_METHODS = ("none", "linear_endpoints")
FILTER_METHODS = ("none", "butterworth_bandpass")
BLOCK = 65536
STEP = 64


def zero_waveforms(
    samples: DataFrame,
    keys: Sequence[str],
    *,
    method: str = "linear_endpoints",
    value: str = "value",
    where: Column | None = None,
    tile: str | None = None,
) -> DataFrame:
    """Subtract from each waveform the straight line between its end values, by sample index.

    Waveforms outside ``where`` (a condition on ``keys``) pass unchanged. With ``tile`` the end values
    meet the samples tile by tile, so samples already dealt by a key and the tile are not shuffled.
    """
    if _checked(method) == "none":
        return samples
    chosen = samples if where is None else samples.filter(where)
    point = F.struct("sample_index", value)
    by = list(keys) if tile is None else [*keys, tile]
    ends = chosen.groupBy(*by).agg(F.min(point).alias("_a"), F.max(point).alias("_b"))
    if tile is not None:
        whole = Window.partitionBy(*keys)
        ends = ends.withColumns({"_a": F.min("_a").over(whole), "_b": F.max("_b").over(whole)})
    ends = ends.select(
        *by, F.col(f"_a.{value}").alias("_first"), F.col(f"_b.{value}").alias("_last"), F.col("_b.sample_index").alias("_steps")
    )
    step = F.coalesce(F.try_divide(F.col("_last") - F.col("_first"), F.col("_steps")), F.lit(0.0))
    at_end = (F.col("sample_index") == F.col("_steps")) & (F.col("_steps") > 0)
    baseline = F.when(at_end, F.col("_last")).otherwise(F.col("_first") + F.col("sample_index") * step)
    return (
        samples.join(ends, by, "left")
        .withColumn(value, F.col(value) - F.coalesce(baseline, F.lit(0.0)))
        .drop("_first", "_last", "_steps")
    )


def check_band(sampling_rate_hz: float, low_hz: float, high_hz: float) -> None:
    half = sampling_rate_hz / 2
    if not 0 < low_hz < high_hz < half:
        raise ValueError(f"band {low_hz} to {high_hz} Hz is not inside 0 to {half} Hz")


def butterworth_sections(order: int, low_hz: float, high_hz: float, sampling_rate_hz: float) -> np.ndarray:
    """Band-pass Butterworth as second-order sections ``[b0 b1 b2 1 a1 a2]``.

    Analogue prototype poles on the unit circle, band-pass transform at pre-warped edges, bilinear
    map; every section takes one zero at +1 and one at -1. Unit gain at the band centre.
    """
    check_band(sampling_rate_hz, low_hz, high_hz)
    rate = 2.0 * sampling_rate_hz
    warped = rate * np.tan(np.pi * np.array([low_hz, high_hz]) / sampling_rate_hz)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    k = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * width / 2
    shift = np.sqrt(prototype**2 - centre**2)
    analogue = np.concatenate([prototype + shift, prototype - shift])
    poles = (rate + analogue) / (rate - analogue)
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    pairs = [(p, np.conj(p)) for p in upper] + list(zip(real[::2], real[1::2], strict=True))
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -(p + q).real, (p * q).real] for p, q in pairs])
    z = np.exp(2j * np.arctan(centre / rate))
    gain = np.prod([abs((1 - z**-2) / (1 + s[4] / z + s[5] / z**2)) for s in sections])
    sections[0, :3] /= gain
    return sections


def pad_length(sections: np.ndarray) -> int:
    """Samples the filter extends a waveform by at each end; not longer means not filtered."""
    # Every section built here has all five coefficients, so none shortens the start-up.
    return 3 * (2 * len(sections) + 1)


def halo_length(sections: np.ndarray) -> int:
    """Samples after which the filter has forgotten any earlier input, to below double precision."""
    slowest = max(abs(np.roots(s[3:])).max() for s in sections)
    return int(-(-np.log(1e-18) / np.log(slowest) // STEP) * STEP)


def _steady_state(sections: np.ndarray) -> np.ndarray:
    """State of the cascade after a long constant input of 1."""
    level, states = 1.0, []
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        states += [level * (gain - b0), level * (b2 - a2 * gain)]
        level *= gain
    return np.array(states)


def _run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run the cascade over the last axis of ``x`` (rows, samples); state is (rows, 2 per section)."""
    y, state = x.astype(float).copy(), state.copy()
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        first, second = state[:, 2 * s].copy(), state[:, 2 * s + 1].copy()
        for i in range(y.shape[1]):
            value = y[:, i].copy()
            y[:, i] = b0 * value + first
            first = b1 * value - a1 * y[:, i] + second
            second = b2 * value - a2 * y[:, i]
        state[:, 2 * s], state[:, 2 * s + 1] = first, second
    return y, state


class _Kernel(NamedTuple):
    """The cascade over ``STEP`` samples at once, as matrices."""

    response: np.ndarray  # samples in -> samples out
    push: np.ndarray  # samples in -> state out
    free: np.ndarray  # state in -> samples out
    carry: np.ndarray  # state in -> state out
    steady: np.ndarray


def _kernel(sections: np.ndarray) -> _Kernel:
    size = 2 * len(sections)
    impulse, _ = _run(sections, np.eye(1, STEP), np.zeros((1, size)))
    response = np.array([np.concatenate([np.zeros(j), impulse[0, : STEP - j]]) for j in range(STEP)])
    push = np.array(
        [_run(sections, np.eye(1, STEP - j), np.zeros((1, size)))[1][0] for j in range(STEP)]
    )
    free, carry = _run(sections, np.zeros((size, STEP)), np.eye(size))
    return _Kernel(response, push, free, carry, _steady_state(sections))


def _one_way(kernel: _Kernel, x: np.ndarray, settled: bool) -> np.ndarray:
    """One causal pass, from the steady state of the first sample when ``settled``, else from rest."""
    rows = -(-len(x) // STEP)
    grid = np.zeros(rows * STEP)
    grid[: len(x)] = x
    grid = grid.reshape(rows, STEP)
    pushes = grid @ kernel.push
    starts = np.empty_like(pushes)
    state = kernel.steady * (x[0] if settled else 0.0)
    for r in range(rows):
        starts[r] = state
        state = state @ kernel.carry + pushes[r]
    return (grid @ kernel.response + starts @ kernel.free).ravel()[: len(x)]


def _zero_phase(kernel: _Kernel, x: np.ndarray, pad: int, at_start: bool, at_end: bool) -> np.ndarray:
    """Filter forward and back; true ends of the waveform are extended by point reflection."""
    left = 2 * x[0] - x[pad:0:-1] if at_start else x[:0]
    right = 2 * x[-1] - x[-2 : -pad - 2 : -1] if at_end else x[:0]
    forward = _one_way(kernel, np.concatenate([left, x, right]), at_start)
    back = _one_way(kernel, forward[::-1], at_end)[::-1]
    return back[len(left) : len(left) + len(x)]


def bandpass(
    samples: DataFrame,
    keys: Sequence[str],
    *,
    sampling_rate_hz: float = 100.0,
    low_hz: float = 0.5,
    high_hz: float = 20.0,
    order: int = 4,
    block: int = BLOCK,
    value: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Zero-phase band-pass over each waveform of ``(keys, sample_index, value)``.

    Missing values count as 0. Waveforms not longer than the padding come back unfiltered. The
    result holds ``keys, sample_index``, the filtered value and the columns named in ``keep``, which
    ride along with their samples. One shuffle, by (keys, block).
    """
    sections = butterworth_sections(order, low_hz, high_hz, sampling_rate_hz)
    pad, halo, kernel = pad_length(sections), halo_length(sections), _kernel(sections)
    if block < halo or halo < pad:
        raise ValueError(f"block must hold at least the halo of {halo} samples")
    keys = list(keys)
    i = F.col("sample_index")
    own = F.floor(i / F.lit(block))
    place = F.pmod(i, F.lit(block))
    copies = F.filter(
        F.array(
            own,
            F.when((place < halo) & (own > 0), own - 1),
            F.when(place >= block - halo, own + 1),
        ),
        lambda b: b.isNotNull(),
    )
    clean = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))
    # Sample numbers are unique in a waveform, so they alone decide the order.
    row = F.struct("sample_index", "_v", *([F.struct(*keep).alias("_kept")] if keep else []))
    blocks = (
        samples.select(*keys, *keep, "sample_index", clean.alias("_v"), F.explode(copies).alias("_block"))
        .groupBy(*keys, "_block")
        .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    )

    def filtered(start: int, x: np.ndarray) -> np.ndarray:
        origin = max(start - halo, 0)
        at_end = len(x) < start + block + halo - origin
        if origin == 0 and at_end and len(x) <= pad:
            return x
        # A waveform that ends inside the block before leaves only halo samples here.
        whole = _zero_phase(kernel, x, pad, origin == 0, at_end)
        return whole[start - origin : start - origin + block]

    @F.pandas_udf("array<double>")
    def run(number: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(
            [
                filtered(int(n) * block, np.asarray(v, dtype=float))
                if len(v) > int(n) * block - max(int(n) * block - halo, 0)
                else np.empty(0)
                for n, v in zip(number, x, strict=True)
            ],
            dtype=object,
        )

    own_rows = F.filter("_rows", lambda r: F.floor(r["sample_index"] / F.lit(block)) == F.col("_block"))
    done = blocks.select(*keys, own_rows.alias("_own"), run("_block", F.col("_rows._v")).alias("_y"))
    each = done.select(*keys, F.inline(F.arrays_zip("_own", "_y")))
    kept = [F.col(f"_own._kept.{c}").alias(c) for c in keep]
    return each.select(*keys, F.col("_own.sample_index").alias("sample_index"), F.col("_y").alias(value), *kept)


def condition(
    samples: DataFrame,
    keys: Sequence[str],
    *,
    acc_filter: str = "butterworth_bandpass",
    acc_zeroing: str = "linear_endpoints",
    strain_zeroing: str = "linear_endpoints",
    tile: str | None = None,
    **band,
) -> DataFrame:
    """Chain by kind of signal: vertical acceleration is filtered then zeroed, strain zeroed only,
    other channels pass. Missing values count as 0. ``keys`` must include ``sensor_name``; ``tile`` as in
    ``zero_waveforms``.
    """
    if acc_filter not in FILTER_METHODS:
        raise ValueError(f"unsupported filter {acc_filter!r}; use one of {FILTER_METHODS}")
    parts = naming.sensor_parts(F.col("sensor_name"))
    is_acc_z = F.coalesce((parts["quantity"] == "ACC") & (parts["axis"] == "Z"), F.lit(False))
    is_strain = F.coalesce(parts["quantity"] == "STR", F.lit(False))
    clean = samples.withColumn(
        "value", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0))
    )
    if acc_filter != "none":
        others = [c for c in clean.columns if c not in (*keys, "sample_index", "value")]
        filtered = bandpass(clean.filter(is_acc_z), keys, keep=others, **band)
        clean = clean.filter(~is_acc_z).unionByName(filtered)
    zeroed_kinds = [
        kind
        for kind, method in ((is_acc_z, acc_zeroing), (is_strain, strain_zeroing))
        if _checked(method) != "none"
    ]
    if not zeroed_kinds:
        return clean
    return zero_waveforms(clean, keys, where=reduce(Column.__or__, zeroed_kinds), tile=tile)


def _checked(method: str) -> str:
    if method not in ZEROING_METHODS:
        raise ValueError(f"unsupported zeroing method {method!r}; use one of {ZEROING_METHODS}")
    return method
