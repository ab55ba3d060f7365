"""Sensor, set and event names: parsing, building and matching."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of the parts in DECK_SPAN_SIDE_LOCATION_QUANTITY[_AXIS].
PARTS = ("deck", "span", "side", "location", "quantity", "axis")


def sensor_parts(name: Column, *, strict: bool = False) -> dict[str, Column]:
    """The six name parts; parts a short name lacks are NULL, or an error when ``strict``."""
    tokens = F.split(name, "_")
    if strict:
        tokens = F.when(F.size(tokens) >= 5, tokens).otherwise(
            F.raise_error(F.concat(F.lit("unrecognised sensor name: "), name)).cast("array<string>")
        )
    return {part: F.get(tokens, F.lit(i)).alias(part) for i, part in enumerate(PARTS)}


def sensor_deck(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def layout_parts(name: Column) -> dict[str, Column]:
    """Placement fields of a sensor, with a reject reason for names the layout does not allow."""
    tokens = F.split(name, "_")
    size = F.size(tokens)

    def part(i: int) -> Column:
        return F.get(tokens, F.lit(i))

    is_acc = (size == 6) & (part(4) == "ACC")
    is_str = (size == 5) & (part(4) == "STR")
    section = F.when(is_acc, part(3)).when(
        is_str, F.when(part(3).isin("INF", "SUP"), F.lit("MID")).otherwise(F.lit("SHE"))
    )
    code = F.when(is_acc, F.concat_ws("_", part(3), F.lit("ACC"), part(5))).when(
        is_str, F.concat_ws("_", part(3), F.lit("STR"))
    )
    known = is_acc | is_str
    group = F.when(known, F.concat_ws("_", part(1), part(2), code))
    other_deck = F.when(part(0) == "OLD", F.lit("NEW")).otherwise(F.lit("OLD"))
    return {
        "deck": part(0),
        "span": part(1),
        "side": part(2),
        "section": section,
        "section_key": F.when(known, F.concat_ws("_", part(1), section)),
        "measurement_family": F.when(known, part(4)),
        "measurement_code": code,
        "axis_or_fibre": F.when(is_acc, part(5)).when(is_str, part(3)),
        "comparison_group_id": group,
        "homologous_sensor_id": F.when(known, F.concat_ws("_", other_deck, group)),
        "reject_reason": F.when(~known, F.lit("unsupported sensor name")).when(
            is_acc & (part(5) == "Y") & (part(2) != "DO"), F.lit("transversal axis outside downstream side")
        ),
    }


def set_label(name: Column) -> Column:
    """``SETn`` when the name holds one, else the name itself."""
    label = F.regexp_extract(name, r"(SET\d+)_", 1)
    return F.when(label != "", label).otherwise(name)


def set_position(name: Column) -> Column:
    number = F.regexp_extract(name, r"SET(\d+)_", 1)
    return F.when(number != "", number.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def set_token(name: Column) -> Column:
    """``SETn`` without leading zeros, for any letter case and spacing; NULL when absent."""
    number = F.regexp_extract(name, r"(?i)SET\s*0*([0-9]+)", 1)
    return F.when(number != "", F.concat(F.lit("SET"), number))


def matches_pattern(name: Column, pattern: str) -> Column:
    """Case-insensitive glob when ``pattern`` holds a glob character, else substring test."""
    wanted = pattern.upper()
    if any(token in wanted for token in "*?[]"):
        return F.upper(name).rlike(r"\A" + fnmatch.translate(wanted)[:-2] + r"\z")
    return F.contains(F.upper(name), F.lit(wanted))


def event_time_token(ts: Column) -> Column:
    """File-safe UTC time; milliseconds appear only when the fraction is not zero."""
    has_fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) != 0
    return F.when(has_fraction, F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss.SSS'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")
    )


def event_id(set_name: Column, deck: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("__", set_name, deck, event_time_token(start), event_time_token(end))


def event_start(event: Column) -> Column:
    """Start time read back from an event id; NULL when the id holds none."""
    token = F.regexp_extract(event, r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})", 1)
    return F.try_to_timestamp(token, F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def metric_unit(metric: Column, family: Column) -> Column:
    # Units shown beside each metric.
    return (
        F.when(metric == "event_count", F.lit("records"))
        .when(metric == "mean_duration", F.lit("s"))
        .when(metric == "mean_temperature", F.lit("deg C"))
        .when(family == "ACC", F.lit("g"))
        .otherwise(F.lit("mm/m"))
    )
