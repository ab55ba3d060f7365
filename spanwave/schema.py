"""Column layouts of the tables that pass between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _table(columns: str) -> T.StructType:
    """A schema from ``name type`` pairs; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Stage table columns, in storage order.
EVENTS = _table(
    "event_id string, set_name string, deck string, start_time_utc timestamp, end_time_utc timestamp, "
    "active_sensor_count bigint, active_sensors array<string>, excluded_sensor_count bigint, "
    "excluded_sensors array<string>, excluded_sensor_reasons array<string>, reference_sensor string, "
    "rows_before_alignment bigint, rows_after_alignment bigint, discarded boolean, "
    "discard_reason string, zeroing_method string"
)

EVENT_SENSORS = _table(
    "event_id string, set_name string, deck string, sensor_name string, sensor_order int, "
    "sensor_status string, exclusion_reason string, exclusion_source string, is_reference int, "
    "record_uid bigint, raw_file string, start_row_1based bigint, end_row_1based bigint, "
    "start_time_utc timestamp, end_time_utc timestamp, duration double, temperature double, "
    "start_value double, end_value double, diff_value double, min_value double, max_value double, "
    "mean_value double, range_value double"
)

ALIGNED_SAMPLES = _table(
    "event_id string, set_name string, deck string, sensor_name string, sample_index bigint, "
    "timestamp_utc timestamp, value double"
)

STORED_SAMPLES = T.StructType([*ALIGNED_SAMPLES.fields[:-1], T.StructField("value", T.FloatType())])

SENSORS = _table(
    "sensor_name string, deck string, span string, side string, location string, "
    "quantity string, axis string"
)

INDEX_COLUMNS = _table(
    "Record_UID bigint, File string, Start_Row bigint, End_Row bigint, Start_Time string, "
    "End_Time string, Duration double, Start_Value double, End_Value double, Diff_Value double, "
    "Min_Value double, Max_Value double, Mean_Value double, Range double, Temperature double, Tag string"
)

# Columns an index table must have before events can be built from it.
REQUIRED_INDEX_COLUMNS = ("File", "Start_Row", "End_Row", "Start_Time", "End_Time")


def resolve_column(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate present in ``df``: exact spelling wins, then any letter case."""
    for candidate in candidates:
        if candidate in df.columns:
            return candidate
    by_lower = {name.lower(): name for name in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def require_columns(df: DataFrame, *names: str) -> dict[str, str]:
    """Map each wanted name to its spelling in ``df``; a missing one is a ``KeyError``."""
    found = {name: resolve_column(df, name) for name in names}
    missing = [name for name, actual in found.items() if actual is None]
    if missing:
        raise KeyError(f"missing column(s): {', '.join(missing)}")
    return found


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns from ``df`` with its types; absent columns become NULL."""
    columns: list[Column] = []
    for field in schema.fields:
        actual = resolve_column(df, field.name)
        if actual is None:
            column = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, (T.DoubleType, T.LongType, T.IntegerType)):
            column = F.col(f"`{actual}`").try_cast(field.dataType)
        else:
            column = F.col(f"`{actual}`").cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)
