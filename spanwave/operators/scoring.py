"""Scores against a reference period: errors, thresholds, exceedances, set and sensor scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwave.functions import naming
from spanwave.operators import sequence
from spanwave.operators.sizing import small

# Share of each modality in the total error.
WEIGHTS = {"strain": 1.0, "acc": 1.0, "temperature": 0.1}
# Upper limits of the health bands, in percent of events above the threshold.
HEALTH_LIMITS = (1.5, 3.0, 4.5, 6.0)
HEALTH_BANDS = ("near_reference", "slight", "moderate", "marked", "most_deviated")


def squared_error(original: Column, reconstruction: Column) -> Column:
    """Mean squared difference of two arrays of one length."""
    pairs = F.zip_with(original, reconstruction, lambda x, y: (x - y) * (x - y))
    return F.aggregate(pairs, F.lit(0.0), lambda total, e: total + e) / F.size(original)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def channel_errors(values: Column, channels: int) -> Column:
    """Per channel of a channel-major array: mean squared distance to the channel's own mean.

    Each channel is paired with its mean before the distances are taken, so the time grows with the
    width of the array, not with its square.
    """
    width = (F.size(values) / F.lit(channels)).cast("int")

    def with_mean(channel: Column) -> Column:
        own = F.slice(values, channel * width + 1, width)
        return F.struct(own.alias("own"), mean_of(own).alias("mean"))

    def error(pair: Column) -> Column:
        mean = pair["mean"]
        total = F.aggregate(pair["own"], F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean))
        return total / F.size(pair["own"])

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), with_mean), error)


def total_error(strain: Column, acc: Column, temperature: Column, weights: dict[str, float] | None = None) -> Column:
    w = {**WEIGHTS, **(weights or {})}
    return w["strain"] * strain + w["acc"] * acc + w["temperature"] * temperature


def score_samples(values: DataFrame, reconstructed: Column | str, keys: Sequence[str]) -> DataFrame:
    """Mean squared error per key from exploded values and a reconstruction column."""
    guess = F.col(reconstructed) if isinstance(reconstructed, str) else reconstructed
    gap = F.col("value") - guess
    return values.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"))


def score_events(sample_errors: DataFrame, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Event scores: the mean of each error over the event's channels."""
    return sample_errors.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def threshold(
    scores: DataFrame, reference: Column, *, measure: str = "total", percentile: float = 0.99
) -> DataFrame:
    """One-row threshold: a percentile of the reference period's scores."""
    limits = sequence.quantiles(scores.filter(reference), [], measure, [percentile])
    return limits.select(F.col("quantile").alias("threshold"))


def flag_exceedances(scores: DataFrame, limit: DataFrame, *, measure: str = "total") -> DataFrame:
    """Add the threshold and whether the score is strictly above it."""
    return scores.withColumn("threshold", limit.scalar()).withColumn(
        "above", F.col(measure) > F.col("threshold")
    )


def exceedance_rates(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if("above").alias("above_count"),
        F.avg(F.col("above").cast("double")).alias("above_rate"),
    )


def modality_rates(
    scores: DataFrame,
    reference: Column,
    measures: dict[str, str],
    *,
    keys: Sequence[str] = ("set_name",),
    percentile: float = 0.99,
) -> DataFrame:
    """Exceedance rate per set and modality; each modality has its own reference threshold."""
    long = scores.unpivot(
        ["event_id", *keys], list(measures), "measure", "score"
    ).withColumn("modality", _rename(F.col("measure"), measures))
    limits = sequence.quantiles(long.filter(reference), ["modality"], "score", [percentile]).select(
        "modality", F.col("quantile").alias("threshold")
    )
    # One row per modality.
    flagged = long.join(F.broadcast(limits), "modality").withColumn(
        "above", F.col("score") > F.col("threshold")
    )
    return exceedance_rates(flagged, [*keys, "modality"])


def _rename(column: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for old, new in names.items():
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out


def compare_sets(flagged: DataFrame, *, measure: str = "total") -> DataFrame:
    """Per set: size, mean, median, population deviation, percent above the threshold, temperature."""
    medians = sequence.quantiles(flagged, ["set_name"], measure, [0.5]).select(
        "set_name", F.col("quantile").alias("median_error")
    )
    summary = flagged.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(measure).alias("mean_error"),
        F.stddev_pop(measure).alias("std_error"),
        (100 * F.avg(F.col("above").cast("double"))).alias("pct_above"),
        F.avg("temperature").alias("mean_temperature"),
        F.min("temperature").alias("min_temperature"),
        F.max("temperature").alias("max_temperature"),
    )
    return summary.join(medians, "set_name")


def relative_change(summary: DataFrame, reference_set: str) -> DataFrame:
    """Change of each other set's median against the reference set's, in percent."""
    base = summary.filter(F.col("set_name") == reference_set).select("median_error").scalar()
    return summary.filter(F.col("set_name") != reference_set).select(
        "set_name",
        "median_error",
        F.try_divide((F.col("median_error") - base) * 100, base).alias("relative_change_pct"),
    )


def error_summary(errors: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each error measure."""
    parts = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return errors.groupBy(*keys).agg(*parts)


def value_diagnostics(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
        F.stddev_pop("value").alias("std_value"),
    )


def sanity_flags(
    values: DataFrame, keys: Sequence[str], *, max_abs_strain: float = 1.0, max_acc: float = 10.0
) -> DataFrame:
    """Groups with NaN values, outsized strain (by magnitude) or outsized acceleration spectrum."""
    nan = F.coalesce(F.isnan("value"), F.lit(False))
    known = F.when(~nan, F.col("value"))
    is_strain = F.col("modality") == "strain"
    return (
        values.groupBy(*keys)
        .agg(
            F.max(nan).alias("has_nan"),
            F.max(F.when(is_strain, F.abs(known))).alias("_strain"),
            F.max(F.when(F.col("modality") == "acc", known)).alias("_acc"),
        )
        .select(
            *keys,
            "has_nan",
            F.coalesce(F.col("_strain") > max_abs_strain, F.lit(False)).alias("strain_too_large"),
            F.coalesce(F.col("_acc") > max_acc, F.lit(False)).alias("acc_too_large"),
        )
    )


def histogram(
    scores: DataFrame, keys: Sequence[str], measure: str, *, bins: int = 60, clip_percentile: float | None = 0.995
) -> DataFrame:
    """Counts in equal bins per group, over the range of the group after clipping at a percentile of all."""
    value = F.col(measure)
    if clip_percentile is not None:
        clip = sequence.quantiles(scores, [], measure, [clip_percentile]).select("quantile").scalar()
        scores = scores.withColumn("_clip", clip)
        value = F.least(value, F.col("_clip"))
    clipped = scores.select(*keys, value.alias("_v"))
    limits = clipped.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = F.coalesce(
        F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)
    )
    return (
        clipped.join(limits, list(keys))
        .withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_quantiles(scores: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Quartiles per group."""
    long = sequence.quantiles(scores, keys, measure, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    return long.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def most_extreme(scores: DataFrame, measure: str = "total", n: int = 10) -> DataFrame:
    """The ``n`` highest scores of all sets."""
    return scores.orderBy(F.desc(measure), "event_id").limit(n)


def worst_channels(errors: DataFrame, keys: Sequence[str], channel: str, measure: str) -> DataFrame:
    """The channel with the largest error per group, the lowest channel on ties."""
    return errors.groupBy(*keys).agg(
        F.max_by(channel, F.struct(F.col(measure), -F.col(channel))).alias("worst_channel"),
        F.max(measure).alias("worst_error"),
    )


def worst_sensor_counts(squared_errors: DataFrame) -> DataFrame:
    """How often each sensor has the largest error norm of its event.

    The norm is taken over the squared errors of a sensor's samples, as the source analysis does.
    """
    norms = squared_errors.groupBy("event_id", "channel").agg(
        F.sqrt(F.sum(F.col("squared_error") * F.col("squared_error"))).alias("norm")
    )
    worst = worst_channels(norms, ["event_id"], "channel", "norm")
    return worst.groupBy("worst_channel").agg(F.count(F.lit(1)).alias("event_count"))


def best_and_worst(scores: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    order = F.struct(F.col(measure), F.col("event_id"))
    return scores.groupBy(*keys).agg(
        F.min_by("event_id", order).alias("best_event"),
        F.max_by("event_id", order).alias("worst_event"),
    )


def chronological(flagged: DataFrame) -> DataFrame:
    """Scores in order of the start time held in the event id; ids without one are left out."""
    timed = flagged.withColumn("event_time", naming.event_start(F.col("event_id")))
    return timed.filter(F.col("event_time").isNotNull()).orderBy("event_time", "event_id")


def baseline_scores(
    features: DataFrame, reference: Column, feature_columns: Sequence[str]
) -> DataFrame:
    """Median absolute Z of an event's features against their reference-period distribution.

    Each (sensor, feature) is standardised with the reference mean and deviation; the median runs
    over the event's sensors and features, whose number the sensor layout bounds.
    """
    long = features.unpivot(
        ["event_id", "set_name", "sensor_name"], list(feature_columns), "feature", "value"
    ).filter(F.col("value").isNotNull())
    fitted = (
        long.filter(reference)
        .groupBy("sensor_name", "feature")
        .agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    )
    z = F.abs(F.try_divide(F.col("value") - F.col("_mean"), F.when(F.col("_std") > 0, F.col("_std"))))
    return (
        long.join(small(fitted), ["sensor_name", "feature"])
        .withColumn("_z", z)
        .filter(F.col("_z").isNotNull())
        .groupBy("event_id", "set_name")
        .agg(F.percentile("_z", F.lit(0.5)).alias("score"), F.count(F.lit(1)).alias("feature_count"))
    )


def health_band(rate_pct: Column) -> Column:
    """Band of a percentage of events above the threshold; each limit belongs to the lower band."""
    band = F.lit(HEALTH_BANDS[-1])
    for limit, name in reversed(list(zip(HEALTH_LIMITS, HEALTH_BANDS, strict=False))):
        band = F.when(rate_pct <= limit, F.lit(name)).otherwise(band)
    return F.when(rate_pct.isNotNull() & ~F.isnan(rate_pct), band)


def score_to_anomaly(score: Column) -> Column:
    return F.greatest(F.lit(0.0), (100 - score) / 12)


def set_scores(flagged: DataFrame, reference_set: str, *, measure: str = "total") -> DataFrame:
    """Set score 0-100 from how often and how far events pass the threshold.

    Own definition, as the source gives words only: burden = rate of exceedance times one plus the
    mean relative excess; score = 100 / (burden / reference burden), at most 100.
    """
    excess = F.greatest(F.col(measure) / F.col("threshold") - 1, F.lit(0.0))
    per_set = flagged.groupBy("set_name").agg(
        F.avg(F.col("above").cast("double")).alias("frequency"), F.avg(excess).alias("severity")
    )
    burden = per_set.withColumn("burden", F.col("frequency") * (1 + F.col("severity")))
    base = burden.filter(F.col("set_name") == reference_set).select("burden").scalar()
    return burden.withColumn("_base", base).select(
        "set_name",
        "frequency",
        "severity",
        F.least(
            F.lit(100.0), F.coalesce(100 * F.try_divide(F.col("_base"), F.col("burden")), F.lit(100.0))
        ).alias("score"),
    )


def sensor_trends(history: DataFrame, *, measure: str, tolerance: float) -> DataFrame:
    """Trend class of each sensor's series over sets from its least-squares slope.

    ``history`` holds ``sensor_name, set_position`` and a score where higher means worse.
    """
    x, y = F.col("set_position").cast("double"), F.col(measure)
    n = F.count(F.lit(1))
    slope = F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), n * F.sum(x * x) - F.sum(x) * F.sum(x))
    return (
        history.groupBy("sensor_name")
        .agg(n.alias("sets"), slope.alias("slope"))
        .withColumn(
            "trend",
            F.when(F.col("slope") > tolerance, F.lit("degrading"))
            .when(F.col("slope") < -tolerance, F.lit("improving"))
            .otherwise(F.lit("stable")),
        )
    )


def attach_set_rates(sensors: DataFrame, rates: DataFrame) -> DataFrame:
    """Give each sensor of a set the set's rate for its own family (``acc_rate`` or ``strain_rate``)."""
    keyed = sensors.withColumn("set_token", naming.set_token(F.col("set_name")))
    return (
        keyed.join(rates, "set_token")
        .withColumn(
            "rate_pct",
            F.when(F.col("measurement_family") == "ACC", F.col("acc_rate")).otherwise(F.col("strain_rate")),
        )
        .drop("acc_rate", "strain_rate")
    )


def split_metric_names(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Melt result columns ``method_type`` into method, labelled type and value."""
    # Labels of the measurement types.
    labels = {"acc": "Accelerometers", "sg": "Strain Gauges", "comb": "All sensors"}
    long = wide.unpivot(list(keys), list(metrics), "metric", "value")
    tokens = F.split("metric", "_", 2)
    kind = F.get(tokens, F.lit(1))
    label = kind
    for code, text in labels.items():
        label = F.when(kind == code, F.lit(text)).otherwise(label)
    return long.withColumns({"method": F.get(tokens, F.lit(0)), "type": label})


def fit_projection(values: DataFrame, k: int) -> PCAModel:
    """Principal axes of the reference rows (``values`` array, already centred)."""
    vectors = values.select(array_to_vector(F.col("values")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(vectors)


def project(model: PCAModel, values: DataFrame) -> DataFrame:
    """Add ``latent``, the coordinates on the fitted axes; the model is not refitted."""
    vectors = values.withColumn("v", array_to_vector(F.col("values")))
    return model.transform(vectors).withColumn("latent", vector_to_array("p")).drop("v", "p")


def turned(model: PCAModel, latent: Column) -> Column:
    """Coordinates on axes that each point to the side of their largest part, so that signs repeat."""
    axes = model.pc.toArray()
    signs = np.where(axes.max(axis=0) >= -axes.min(axis=0), 1.0, -1.0)
    return F.array(*[F.get(latent, F.lit(i)) * F.lit(float(s)) for i, s in enumerate(signs)])


def reconstruct(model: PCAModel, projected: DataFrame) -> DataFrame:
    """Add ``reconstruction``, the latent coordinates mapped back by the fitted axes."""
    axes = model.pc.toArray()  # positions x k, both fixed by the tensor shape

    @F.pandas_udf("array<double>")
    def back(latent: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(latent.to_list()) @ axes.T)) if len(latent) else pd.Series([], dtype=object)

    return projected.withColumn("reconstruction", back("latent"))


def centre(values: DataFrame, reference: Column, width: int) -> DataFrame:
    """Subtract the reference rows' mean of each array position."""
    means = values.filter(reference).agg(
        F.array(*[F.avg(F.get("values", F.lit(i))) for i in range(width)])
    )
    return values.withColumn("_means", means.scalar()).withColumn(
        "values", F.zip_with("values", "_means", lambda v, m: v - m)
    ).drop("_means")
