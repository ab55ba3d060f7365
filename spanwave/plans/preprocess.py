"""The preprocessing job from index records to aligned samples, as one job."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.functions import times
from spanwave.operators import align, conditioning, events, joins, sequence
from spanwave.session import cut_lineage, discard, stage_bucketed

KEYS = ["event_id", "sensor_name"]
PLACE = ["event_id", "tile"]


@dataclass(frozen=True)
class Settings:
    grouping_method: str = "shared_start"
    decks: tuple[str, ...] = ()
    strain_locations: tuple[str, ...] = ("INF", "SUP")
    acc_axis: str = "Z"
    min_active_sensors: int = 1
    acc_filter: str = "butterworth_bandpass"
    acc_zeroing: str = "linear_endpoints"
    strain_zeroing: str = "linear_endpoints"
    band: dict[str, float] = field(default_factory=dict)
    tile_seconds: int = 60


class Run:
    """One preprocessing run: group, select, discard, slice, condition and align.

    Tables are built when first asked for. Events that fail the sensor rule never reach the samples.
    The annotated records go to the checkpoint folder on the way; samples are written once as they are
    cut out, filtered ones once more, and the aligned rows, all in buckets of (event, tile). So the tables
    built from them share one computation and one shuffle, and a lost executor costs a re-read. ``slots`` may be passed when the number of sensors per event is known, which saves the
    small job that counts them.
    """

    def __init__(
        self,
        records: DataFrame,
        samples: DataFrame,
        settings: Settings,
        *,
        exclusions: DataFrame | None = None,
        slots: int | None = None,
    ) -> None:
        self._records, self._samples, self._exclusions = records, samples, exclusions
        self._slots = slots
        self.settings = settings

    @cached_property
    def annotated(self) -> DataFrame:
        """Records with event and inclusion status; thousands of times smaller than the samples."""
        s = self.settings
        grouped = events.assign_event_groups(events.add_sensor_order(self._records), s.grouping_method)
        return cut_lineage(
            events.annotate_records(
                grouped,
                decks=s.decks,
                strain_locations=s.strain_locations,
                acc_axis=s.acc_axis,
                exclusions=self._exclusions,
            )
        )

    @cached_property
    def found(self) -> DataFrame:
        return events.group_events(events.included_records(self.annotated))

    @cached_property
    def slots(self) -> int:
        """Sensors of the fullest event: one number that fixes the width of the alignment."""
        return self._slots or int(self.found.agg(F.max("active_sensor_count")).first()[0] or 1)

    @cached_property
    def _usable(self) -> DataFrame:
        heavy = self.found.filter(F.col("active_sensor_count") >= self.settings.min_active_sensors)
        return events.included_records(self.annotated).join(heavy.select("event_id"), "event_id", "left_semi")

    @cached_property
    def _slotted(self) -> DataFrame:
        collapsed, _ = events.collapse_single_file(self._usable)
        return align.add_slots(
            collapsed.select(
                "event_id", "set_name", "deck", "sensor_name", "sensor_order", "raw_file",
                "start_row_1based", "end_row_1based",
            )
        )

    @cached_property
    def conditioned(self) -> DataFrame:
        """Numbered, filtered and zeroed samples of every usable event and sensor.

        The samples cut out are dealt once, to buckets of (event, tile); numbering, zeroing and
        alignment group by these keys and more, so only a filter between them shuffles samples again.
        The samples as they were cut out go once these are written.
        """
        s = self.settings
        rows = joins.drop_unparsed(joins.slice_records(self._slotted, self._samples)).withColumn(
            "tile", times.time_tile(F.col("timestamp_utc"), s.tile_seconds)
        )
        cut_out = stage_bucketed(rows, PLACE)
        ready = conditioning.condition(
            sequence.ordinal(cut_out, KEYS, ["timestamp_utc", "row_1based"], "tile", "sample_index"),
            KEYS,
            acc_filter=s.acc_filter,
            acc_zeroing=s.acc_zeroing,
            strain_zeroing=s.strain_zeroing,
            tile="tile",
            **s.band,
        )
        ready = stage_bucketed(ready, PLACE, dealt=s.acc_filter == "none")
        discard(cut_out)
        return ready

    @cached_property
    def _aligned(self) -> DataFrame:
        return stage_bucketed(align.align(self.conditioned, self.slots), PLACE, dealt=True)

    @cached_property
    def aligned_samples(self) -> DataFrame:
        return align.aligned_long(self._aligned, self._slotted, keep=("set_name", "deck"))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return align.diagnostics(self.conditioned, self._aligned, self._slotted)

    @cached_property
    def _marked(self) -> DataFrame:
        counts = self._aligned.groupBy("event_id").agg(F.count(F.lit(1)).alias("aligned_rows"))
        return events.mark_discards(
            self.found, min_active_sensors=self.settings.min_active_sensors, aligned_counts=counts
        )

    @cached_property
    def events(self) -> DataFrame:
        """The event manifest, retained and discarded."""
        before = (
            self.conditioned.filter("slot = 0")
            .groupBy("event_id")
            .agg(F.count(F.lit(1)).alias("rows_before_alignment"))
        )
        details = [events.reference_sensors(self._usable), before, events.excluded_per_event(self.annotated)]
        joined = reduce(lambda left, right: left.join(right, "event_id", "left"), details, self._marked)
        s = self.settings
        return joined.withColumns(
            {
                "reference_sensor": F.coalesce("reference_sensor", F.lit("")),
                "rows_before_alignment": F.coalesce("rows_before_alignment", F.lit(0)),
                "excluded_sensor_count": F.coalesce("excluded_sensor_count", F.lit(0)),
                "zeroing_method": F.lit(
                    f"strain:{s.strain_zeroing};acc_{s.acc_axis.lower()}:{s.acc_zeroing}"
                ),
            }
        )

    @cached_property
    def event_sensors(self) -> DataFrame:
        return events.event_sensor_rows(self.annotated, events.reference_sensors(self._usable))

    @cached_property
    def exclusion_log(self) -> DataFrame:
        return events.exclusion_log(self.annotated)

    @cached_property
    def summary(self) -> DataFrame:
        return events.run_summary(self._marked, self.exclusion_log)
