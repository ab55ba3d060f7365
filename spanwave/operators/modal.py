"""Frequency-domain decomposition per (set, deck): spectra, singular values, peaks, mode shapes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import naming, numbers
from spanwave.operators import sequence
from spanwave.operators.sizing import small
from spanwave.session import cut_lineage, stage

GROUP = ["set_name", "deck"]
#: Values of the segments transformed at once in a task.
VALUES_AT_ONCE = 1 << 20


def channels_of(
    event_sensors: DataFrame, *, quantity: str = "ACC", axis: str | None = "Z"
) -> DataFrame:
    """Included rows of the event-sensor table that carry the wanted quantity and axis."""
    parts = naming.sensor_parts(F.col("sensor_name"))
    rows = event_sensors.filter((F.col("sensor_status") == "included") & (parts["quantity"] == quantity))
    return rows if axis is None else rows.filter(parts["axis"] == axis)


def candidate_events(channel_rows: DataFrame, *, require_full_channel_set: bool = True) -> DataFrame:
    """Events usable for decomposition: exactly the channels its (set, deck) ever shows, or at least two."""
    expected = channel_rows.groupBy(*GROUP).agg(
        F.array_sort(F.collect_set("sensor_name")).alias("expected_channels")
    )
    per_event = channel_rows.groupBy(*GROUP, "event_id").agg(
        F.min("start_time_utc").alias("start_time_utc"),
        F.array_sort(F.collect_set("sensor_name")).alias("channels"),
    )
    joined = per_event.join(expected, GROUP).filter(F.size("channels") >= 2)
    return (
        joined.filter(F.col("channels") == F.col("expected_channels")) if require_full_channel_set else joined
    )


def first_events(candidates: DataFrame, max_events: int | None = None) -> DataFrame:
    """The earliest ``max_events`` candidates of each (set, deck); ``None`` keeps all.

    Partial top-k per tile of events first, so no (set, deck) is ranked in one task.
    """
    if max_events is None:
        return candidates
    order = ["start_time_utc", "event_id"]
    spread = candidates.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    local = Window.partitionBy(*GROUP, "_salt").orderBy(*order)
    total = Window.partitionBy(*GROUP).orderBy(*order)
    return (
        spread.withColumn("_r", F.row_number().over(local))
        .filter(F.col("_r") <= max_events)
        .withColumn("_r", F.row_number().over(total))
        .filter(F.col("_r") <= max_events)
        .drop("_r", "_salt")
    )


def common_channels(selected: DataFrame) -> DataFrame:
    """Channels shared by all selected events of a (set, deck)."""
    events = selected.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_events"))
    return (
        selected.select(*GROUP, F.explode("channels").alias("sensor_name"))
        .groupBy(*GROUP, "sensor_name")
        .agg(F.count(F.lit(1)).alias("_in"))
        .join(events, GROUP)
        .filter(F.col("_in") == F.col("_events"))
        .select(*GROUP, "sensor_name")
    )


def matrix_report(selected: DataFrame, matrices: DataFrame, *, min_rows: int = 2, min_common_events: int = 2) -> DataFrame:
    """Every selected event with its full rows and why it is left out, NULL if it is used.

    ``matrices`` are those of ``event_matrices`` without limits (``min_rows=1, min_common_events=1``).
    """
    keys = [*GROUP, "event_id"]
    sizes = matrices.groupBy(*keys).agg(F.max("row_count").alias("row_count"))
    rows = selected.select(*keys).join(sizes, keys, "left")
    enough = rows.groupBy(*GROUP).agg(F.count_if(F.col("row_count") >= min_rows).alias("_long"))
    reason = (
        F.when(F.col("row_count").isNull(), F.lit("no_full_rows"))
        .when(F.col("row_count") < min_rows, F.lit("too_few_rows"))
        .when(F.col("_long") < min_common_events, F.lit("too_few_events"))
    )
    return rows.join(enough, GROUP).select(*keys, F.coalesce("row_count", F.lit(0)).alias("row_count"), reason.alias("reason"))


def event_matrices(
    samples: DataFrame,
    selected: DataFrame,
    channels: DataFrame,
    *,
    tile: str = "tile",
    min_common_events: int = 2,
    min_rows: int = 2,
) -> DataFrame:
    """Samples of the selected events on the common channels, rows with a gap removed.

    One result row per sample: its number from 0 in the event and ``values`` by channel order. Events
    with fewer than ``min_rows`` full rows, and groups with fewer than two channels or too few events,
    drop out; ``event_count`` counts the events that stay.
    """
    by_name = Window.partitionBy(*GROUP).orderBy("sensor_name")
    everyone = Window.partitionBy(*GROUP)
    numbered = (
        channels.withColumn("channel_index", F.row_number().over(by_name) - 1)
        .withColumn("channel_count", F.count(F.lit(1)).over(everyone))
        .filter(F.col("channel_count") >= 2)
    )
    rows = (
        samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .join(small(selected.select(*GROUP, "event_id")), [*GROUP, "event_id"], "left_semi")
        .join(small(numbered), [*GROUP, "sensor_name"])
    )
    channel = F.struct("channel_index", "value")
    full = (
        rows.groupBy(*GROUP, "event_id", "sample_index", "channel_count")
        .agg(F.array_sort(F.collect_list(channel)).alias("_c"), F.min(tile).alias("_tile"))
        .filter(F.size("_c") == F.col("channel_count"))
        .withColumn("values", F.col("_c.value"))
        .drop("_c")
    )
    full = stage(full)  # numbering and counting read it, so that the samples are read once
    numbered_rows = sequence.ordinal(
        full, [*GROUP, "event_id"], ["sample_index"], "_tile", "row", size="row_count", in_place=True
    ).filter(F.col("row_count") >= min_rows)
    enough = (
        full.groupBy(*GROUP, "event_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= min_rows)
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .filter(F.col("event_count") >= min_common_events)
    )
    # One row a group, so the rows are not dealt by group.
    return numbered_rows.join(F.broadcast(enough), GROUP).select(
        *GROUP, "event_id", "row", "row_count", "event_count", "channel_count", "values"
    )


def segments(matrices: DataFrame, *, nperseg: int = 1024, noverlap: int = 512) -> DataFrame:
    """Cut each event into overlapping segments; one row per segment, ``x`` its rows of channel values.

    A sample joins every segment that covers it (two for half overlap). Events shorter than
    ``nperseg`` make one segment of their own length.
    """
    size = F.least(F.lit(nperseg), F.col("row_count"))
    step = size - F.least(F.lit(noverlap), size - 1)
    count = F.floor((F.col("row_count") - size) / step) + 1
    low = F.greatest(F.ceil((F.col("row") - size + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col("row") / step), count - 1)
    keys = [*GROUP, "event_id", "segment", "segment_length", "segment_count", "event_count"]
    return (
        matrices.select(
            *GROUP,
            "event_id",
            "row",
            "values",
            "event_count",
            size.alias("segment_length"),
            count.alias("segment_count"),
            F.explode(F.when(high >= low, F.sequence(low, high))).alias("segment"),
        )
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("row", "values"))).alias("_x"))
        .select(*keys, F.col("_x.values").alias("x"))
    )


def spectral_density(segmented: DataFrame, *, sampling_rate_hz: float = 100.0) -> DataFrame:
    """Cross-spectral density averaged over segments, then over events with equal weight.

    Periodic Hann window, no padding or detrending, amplitudes scaled by the window sum. Each task
    transforms many segments at once and adds them up before anything is shuffled. Long result:
    ``frequency_index, channel_i, channel_j, re, im``. All events of a group must give the same frequency
    grid.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby([*GROUP, "segment_length", "channels"], dropna=False):
                length, channels = int(key[2]), int(key[3])
                window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
                weights = 1 / (rows["segment_count"] * rows["event_count"]).to_numpy(dtype=float)
                packed = rows["x"].tolist()
                at_once = max(1, VALUES_AT_ONCE // (length * channels))
                for i in range(0, len(packed), at_once):
                    x = np.concatenate(packed[i : i + at_once]).astype(float).reshape(-1, length, channels)
                    z = np.fft.rfft(x * window[:, None], axis=1) / window.sum()
                    weighted = z * weights[i : i + at_once, None, None]
                    cross = weighted.transpose(1, 2, 0) @ z.conj().transpose(1, 0, 2)
                    sums[key] = sums[key] + cross if key in sums else cross
        for (set_name, deck, length, channels), total in sums.items():
            bins = len(total)
            flat = total.reshape(bins, channels * channels)
            yield pd.DataFrame(
                {
                    "set_name": set_name,
                    "deck": deck,
                    "segment_length": length,
                    "frequency_index": np.arange(bins),
                    "channel_count": channels,
                    "re": list(flat.real),
                    "im": list(flat.imag),
                }
            )

    flat_x = [F.size(F.get("x", F.lit(0))).alias("channels"), F.flatten("x").alias("x")]
    partials = segmented.select(*GROUP, "segment_length", "segment_count", "event_count", *flat_x).mapInPandas(
        partial,
        "set_name string, deck string, segment_length bigint, frequency_index bigint, "
        "channel_count bigint, re array<double>, im array<double>",
    )
    frequency = F.col("frequency_index") * F.lit(sampling_rate_hz) / F.col("segment_length")
    lengths = F.col("segment_length")
    of_group = Window.partitionBy(*GROUP)
    one_grid = F.min(lengths).over(of_group) == F.max(lengths).over(of_group)
    return (
        partials.select(
            *GROUP,
            "segment_length",
            "frequency_index",
            frequency.alias("frequency_hz"),
            "channel_count",
            F.posexplode(F.arrays_zip("re", "im")).alias("_at", "_z"),
        )
        .groupBy(*GROUP, "segment_length", "frequency_index", "frequency_hz", "channel_count", "_at")
        .agg(F.sum("_z.re").alias("re"), F.sum("_z.im").alias("im"))
        .withColumn(
            "frequency_index",
            F.when(one_grid, F.col("frequency_index")).otherwise(
                F.raise_error(F.lit("events of one group need one segment length")).cast("bigint")
            ),
        )
        .select(
            *GROUP,
            "frequency_index",
            "frequency_hz",
            F.floor(F.col("_at") / F.col("channel_count")).cast("int").alias("channel_i"),
            F.pmod(F.col("_at"), F.col("channel_count")).cast("int").alias("channel_j"),
            "re",
            "im",
        )
    )


def decompose(density: DataFrame) -> DataFrame:
    """Singular values (falling) and vectors of the density at each frequency.

    One group is one small matrix, channels by channels. Long result: ``mode`` from 0,
    ``singular_value, channel_index, re, im``.
    """

    def one_frequency(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["channel_i"].max()) + 1
        matrix = np.zeros((n, n), dtype=complex)
        matrix[group["channel_i"], group["channel_j"]] = group["re"] + 1j * group["im"]
        values, vectors = np.linalg.eigh(matrix)
        order = np.argsort(values)[::-1]
        mode, channel = np.divmod(np.arange(n * n), n)
        chosen = vectors[channel, order[mode]]
        head = group[[*GROUP, "frequency_index", "frequency_hz"]].iloc[0]
        return pd.DataFrame(
            {
                **{name: head[name] for name in head.index},
                "mode": mode,
                "singular_value": values[order[mode]],
                "channel_index": channel,
                "re": chosen.real,
                "im": chosen.imag,
            }
        )

    return density.groupBy(*GROUP, "frequency_index", "frequency_hz").applyInPandas(
        one_frequency,
        "set_name string, deck string, frequency_index bigint, frequency_hz double, mode int, "
        "singular_value double, channel_index int, re double, im double",
    )


def first_curve(modes: DataFrame) -> DataFrame:
    """The largest singular value over frequency."""
    return modes.filter("mode = 0").select(
        *GROUP, "frequency_index", "frequency_hz", "singular_value"
    ).distinct()


def local_maxima(curve: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Strict interior peaks of a curve; a flat top counts once, at its middle (rounded down).

    A group without any peak gives its highest point, the first on ties.
    """
    along = Window.partitionBy(*keys).orderBy(position)
    starts = F.coalesce(F.col(value) != F.lag(value).over(along), F.lit(True))
    runs = (
        curve.withColumn("_new", starts.cast("int"))
        .withColumn("_place", F.row_number().over(along))
        .withColumn("_run", F.sum("_new").over(along))
        .groupBy(*keys, "_run", value)
        .agg(F.min("_place").alias("_from"), F.max("_place").alias("_to"))
    )
    by_run = Window.partitionBy(*keys).orderBy("_run")
    whole = Window.partitionBy(*keys)
    top = Window.partitionBy(*keys).orderBy(F.desc(value), "_run")
    is_peak = (F.col(value) > F.lag(value).over(by_run)) & (F.col(value) > F.lead(value).over(by_run))
    judged = runs.withColumn("_peak", F.coalesce(is_peak, F.lit(False))).withColumns(
        {"_any": F.max("_peak").over(whole), "_rank": F.row_number().over(top)}
    )
    chosen = judged.filter(F.col("_peak") | (~F.col("_any") & (F.col("_rank") == 1))).select(
        *keys,
        F.when(F.col("_peak"), F.floor((F.col("_from") + F.col("_to")) / 2))
        .otherwise(F.col("_from"))
        .alias("_place"),
    )
    placed = curve.withColumn("_place", F.row_number().over(along))
    return placed.join(chosen, [*keys, "_place"]).drop("_place")


def peaks(
    curve: DataFrame, *, low_hz: float = 0.5, high_hz: float = 20.0, n_peaks: int = 5
) -> DataFrame:
    """The ``n_peaks`` highest peaks in the band, then ranked from 1 by frequency."""
    band = curve.filter(F.col("frequency_hz").between(low_hz, high_hz))
    found = local_maxima(band, GROUP, "frequency_index", "singular_value")
    by_height = Window.partitionBy(*GROUP).orderBy(F.desc("singular_value"), F.desc("frequency_index"))
    by_frequency = Window.partitionBy(*GROUP).orderBy("frequency_hz")
    return (
        found.withColumn("_h", F.row_number().over(by_height))
        .filter(F.col("_h") <= n_peaks)
        .drop("_h")
        .withColumn("peak_rank", F.row_number().over(by_frequency))
    )


def mode_shapes(peak_table: DataFrame, modes: DataFrame) -> DataFrame:
    """First singular vector at each peak, turned so its largest component is real.

    Amplitude and signed real part are each scaled to a maximum of 1; phase is in degrees.
    """
    vectors = modes.filter("mode = 0").drop("mode", "singular_value", "frequency_hz")
    per_peak = Window.partitionBy(*GROUP, "peak_rank")
    size = numbers.magnitude(F.col("re"), F.col("im"))
    # Largest component; channels level with it up to rounding resolve to the first.
    leader = F.max_by(
        F.struct("re", "im"), F.struct(F.round("_size", 9), -F.col("channel_index"))
    ).over(per_peak)
    joined = (
        peak_table.join(vectors, [*GROUP, "frequency_index"])
        .withColumn("_size", size)
        .withColumn("_leader", leader)
    )
    turn = numbers.angle(F.col("_leader.re"), F.col("_leader.im"))
    real, imaginary = numbers.rotate(F.col("re"), F.col("im"), turn)
    turned = joined.withColumns({"_re": real, "_im": imaginary})
    largest, largest_signed = F.max("_size").over(per_peak), F.max(F.abs("_re")).over(per_peak)
    return turned.select(
        *GROUP,
        "peak_rank",
        "frequency_index",
        "frequency_hz",
        "singular_value",
        "channel_index",
        F.when(largest == 0, F.col("_size")).otherwise(F.col("_size") / largest).alias("mode_shape_amplitude"),
        F.when(largest_signed == 0, F.col("_re"))
        .otherwise(F.col("_re") / largest_signed)
        .alias("mode_shape_signed_component"),
        F.degrees(numbers.angle(F.col("_re"), F.col("_im"))).alias("mode_shape_phase_deg"),
    )


def annotate_locations(shapes: DataFrame, channels: DataFrame) -> DataFrame:
    """Add sensor name, its parsed position and a compact position label."""
    parts = naming.sensor_parts(F.col("sensor_name"), strict=True)
    by_name = Window.partitionBy(*GROUP).orderBy("sensor_name")
    names = channels.withColumn("channel_index", F.row_number().over(by_name) - 1)
    return (
        shapes.join(names, [*GROUP, "channel_index"])
        .withColumns({p: parts[p] for p in ("span", "side", "location", "quantity", "axis")})
        .withColumn("position_label", F.concat_ws("_", "span", "side", "location"))
    )


def pivot_shapes(located: DataFrame, value: str, n_peaks: int) -> DataFrame:
    """Location by peak rank, one column per rank."""
    picked = [
        F.max(F.when(F.col("peak_rank") == rank, F.col(value))).alias(f"peak_{rank}")
        for rank in range(1, n_peaks + 1)
    ]
    return located.groupBy(*GROUP, "position_label").agg(*picked)


def family_status(
    events: DataFrame,
    channel_rows: DataFrame,
    candidates: DataFrame,
    selected: DataFrame,
    channels: DataFrame,
    matrices: DataFrame,
    *,
    quantity: str = "ACC",
    axis: str = "Z",
    min_common_events: int = 2,
    require_full_channel_set: bool = True,
) -> DataFrame:
    """Per (set, deck) of the retained ``events``: whether its modal features were computed, why not,
    and the counts of events and channels.

    The other tables are those of the steps in between: the included channels of the events, the
    candidates, the selected events, their common channels and the matrices.
    """
    count = F.count(F.lit(1))
    shown = channel_rows.groupBy(*GROUP).agg(F.count_distinct("sensor_name").alias("_expected"))
    tables = (
        shown,
        candidates.groupBy(*GROUP).agg(count.alias("_candidates")),
        selected.groupBy(*GROUP).agg(count.alias("_selected")),
        channels.groupBy(*GROUP).agg(count.alias("_common")),
        matrices.groupBy(*GROUP).agg(F.max("event_count").alias("_used"), F.max("channel_count").alias("_channels")),
    )
    rows = events.groupBy(*GROUP).agg(count.alias("_events"))
    for table in tables:
        rows = rows.join(table, GROUP, "left")
    rows = rows.fillna(0, ["_expected", "_candidates", "_selected", "_common"])
    done = F.col("_used").isNotNull()
    few = F.col("_selected") < min_common_events
    # The details of a family that was or was not computed.
    label = f"{quantity}_{axis}"
    computed = F.format_string("computed from %d retained events", "_used")
    if require_full_channel_set:
        detail = (
            F.when(done, computed)
            .when(F.col("_expected") < 2, F.lit(f"insufficient configured {label} channels"))
            .when(F.col("_candidates") == 0, F.format_string(f"no events with all %d {label} channels", "_expected"))
            .when(few, F.format_string(f"insufficient events with all %d {label} channels", "_expected"))
            .otherwise(F.lit(f"insufficient full-set {label} events after dropping missing rows"))
        )
    else:
        detail = (
            F.when(done, computed)
            .when(few, F.lit(f"insufficient common {label} events"))
            .when(F.col("_common") < 2, F.lit(f"insufficient common {label} channels"))
            .otherwise(F.lit(f"insufficient {label} events after dropping missing rows"))
        )
    named = F.when(few, F.lit(0)).otherwise(F.col("_common"))
    return rows.select(
        *GROUP,
        F.lit(f"{label}_fdd".lower()).alias("feature_family"),
        F.when(done, F.lit("completed")).otherwise(F.lit("skipped")).alias("status"),
        detail.alias("detail"),
        F.coalesce("_used", "_events").alias("event_count"),
        F.coalesce(F.col("_channels").cast("bigint"), named.cast("bigint")).alias("channel_count"),
    )


def run(
    matrices: DataFrame,
    channels: DataFrame,
    *,
    sampling_rate_hz: float = 100.0,
    nperseg: int = 1024,
    noverlap: int = 512,
    low_hz: float = 0.5,
    high_hz: float = 20.0,
    n_peaks: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Peak table and located mode-shape components for every (set, deck) in ``matrices``."""
    density = spectral_density(
        segments(matrices, nperseg=nperseg, noverlap=noverlap), sampling_rate_hz=sampling_rate_hz
    )
    modes = cut_lineage(decompose(density))
    table = peaks(first_curve(modes), low_hz=low_hz, high_hz=high_hz, n_peaks=n_peaks)
    return table, annotate_locations(mode_shapes(table, modes), channels)
