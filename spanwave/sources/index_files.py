"""File sources: JSON index tables, JSON waveforms, CSV event catalogues and sample exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwave import schema
from spanwave.functions import numbers, times
from spanwave.operators import sequence

# Keys under which a JSON file may hold its list of records.
INDEX_WRAPPERS = ("data", "records", "rows", "table")
WAVEFORM_WRAPPERS = ("data", "records", "rows")


def sensor_from_file(name: Column) -> Column:
    """Sensor name of a ``TABLE_<sensor>[_SETn].json`` file name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "TABLE_", ""), r"\.json$", ""), r"_SET[^_]*$", "")


def catalogue(files: DataFrame, observed: DataFrame) -> DataFrame:
    """Sensors by table file (``dataset, table_file``) and whether raw files were observed
    (``dataset, sensor_name``)."""
    seen = observed.select("dataset", "sensor_name", F.lit(True).alias("sensor_dir_exists")).distinct()
    return (
        files.select("dataset", "table_file", sensor_from_file(F.col("table_file")).alias("sensor_name"))
        .join(seen, ["dataset", "sensor_name"], "left")
        .withColumn("sensor_dir_exists", F.coalesce("sensor_dir_exists", F.lit(False)))
    )


def _flat(record: dict, prefix: str = "") -> dict:
    """Nested objects as dotted names."""
    out: dict = {}
    for name, value in record.items():
        if isinstance(value, dict) and value:
            out |= _flat(value, f"{prefix}{name}.")
        else:
            out[prefix + name] = value
    return out


def _by_rows(columns: dict) -> list[dict]:
    """Rows of named lists, short ones padded; a single value belongs to the first row."""
    lists = {name: value if isinstance(value, list) else [value] for name, value in columns.items()}
    length = max(map(len, lists.values()), default=0)
    return [{n: v[i] if i < len(v) else None for n, v in lists.items()} for i in range(length)]


def json_records(data: object, wrappers: Sequence[str]) -> list[dict]:
    """Rows of one parsed JSON document: the rules that ``read_json_rows`` follows on the JVM, for tests of it.

    A list of records; an object with such a list under one of ``wrappers``; an object of columns;
    a single record, nested objects flattened to dotted names. A lone record with lists is one of
    columns. One-element lists stand for their element.
    """
    if isinstance(data, dict):
        data = next((data[w] for w in wrappers if isinstance(data.get(w), list)), data)
    if isinstance(data, dict):
        rows = _by_rows(data) if data and all(isinstance(v, list) for v in data.values()) else [_flat(data)]
    elif isinstance(data, list):
        rows = [r if isinstance(r, dict) else {"0": r} for r in data]
    else:
        raise ValueError(f"a JSON file must hold an object or a list, not {type(data).__name__}")
    if len(rows) == 1 and any(isinstance(v, list) for v in rows[0].values()):
        rows = _by_rows(rows[0])
    return [{n: v[0] if isinstance(v, list) and len(v) == 1 else v for n, v in r.items()} for r in rows]


DEPTH = 8  # levels of nested objects that become dotted names; deeper ones stay JSON text
CELLS = "map<string,string>"


def _list(text: Column) -> Column:
    """The elements of a JSON list as text, NULL for any other text."""
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>"))


def _object(text: Column) -> Column:
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, CELLS))


def _flat_cells(cells: Column) -> Column:
    """Nested objects as dotted names."""

    def opened(entry: Column) -> Column:
        inner = F.map_entries(_object(entry["value"]))
        named = F.transform(inner, lambda x: F.struct(F.concat(entry["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(F.size(inner) > 0, named).otherwise(F.array(entry))

    entries = F.map_entries(cells)
    for _ in range(DEPTH):
        entries = F.flatten(F.transform(entries, opened))
    return F.map_from_entries(entries)


def _rows_of_columns(cells: Column) -> Column:
    """Rows of named lists, short ones padded; a single value belongs to the first row."""
    columns = F.transform(
        F.map_entries(cells),
        lambda e: F.struct(e["key"].alias("key"), F.coalesce(_list(e["value"]), F.array(e["value"])).alias("cells")),
    )

    def rows(c: Column) -> Column:
        length = F.coalesce(F.array_max(F.transform(c, lambda e: F.size(e["cells"]))), F.lit(0))
        row = lambda i: F.map_from_entries(F.transform(c, lambda e: F.struct(e["key"], F.get(e["cells"], i))))
        return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), row)).otherwise(F.array().cast(f"array<{CELLS}>"))

    # Bound by a lambda, the lists are parsed once and not for each of their rows.
    return F.get(F.transform(F.array(columns), rows), F.lit(0))


def _lone_elements(cells: Column) -> Column:
    """One-element lists stand for their element."""
    return F.transform_values(cells, lambda _, v: F.when(F.size(_list(v)) == 1, F.get(_list(v), F.lit(0))).otherwise(v))


def _record(text: Column) -> Column:
    """A list element: an object's cells, or a lone value under the name 0."""
    return F.coalesce(_object(text), F.create_map(F.lit("0"), text))


def document_rows(text: Column, wrappers: Sequence[str]) -> Column:
    """The rows of a JSON document as an array of cells, by the shape of that document alone.

    A list of records; an object with such a list under one of ``wrappers``; an object of columns;
    a single record, nested objects flattened to dotted names. A lone record with lists is one of
    columns. One-element lists stand for their element. Any other document fails.
    """
    strict = {"mode": "FAILFAST"}
    start = F.substring(F.ltrim(F.regexp_replace(text, r"^[\s\x{FEFF}]+", "")), 1, 1)
    whole = F.when(start == "{", F.from_json(text, CELLS, strict))
    wrapped = F.coalesce(*[F.when(F.startswith(whole[w], F.lit("[")), whole[w]) for w in wrappers])
    listed = F.from_json(F.when(start == "[", text).otherwise(wrapped), "array<string>", strict)
    wrong = F.raise_error(F.lit("a JSON file must hold an object or a list")).cast(f"array<{CELLS}>")
    rows = (
        F.when(listed.isNotNull(), F.transform(listed, _record))
        .when(whole.isNotNull(), F.array(_flat_cells(whole)))
        .otherwise(wrong)
    )

    def shaped(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        columns = (F.size(found) == 1) & F.exists(F.map_values(first), lambda v: _list(v).isNotNull())
        return F.when(columns, _rows_of_columns(first)).otherwise(found)

    return F.transform(F.get(F.transform(F.array(rows), shaped), F.lit(0)), _lone_elements)


def read_json_rows(spark: SparkSession, paths: str | Sequence[str], wrappers: Sequence[str], *, lines: bool = False) -> DataFrame:
    """Rows of JSON files, each file by its own shape: ``_path, row_1based, cells``.

    Files of any mix of shapes may come in one call. A JSON document is parsed as a whole, so a file
    is the unit of work and has to fit a task; a file that is no JSON fails the read, an empty one has no rows. All parsing is
    done on the JVM.

    With ``lines`` every line of a file is one record. Such files are split between tasks, however long they are,
    and rows are numbered by the places of the splits; blank lines are no rows.
    """
    path = F.col("_metadata.file_path").alias("_path")
    if not lines:
        files = spark.read.text(paths, wholetext=True)
        rows = files.select(path, F.posexplode(document_rows(F.col("value"), wrappers)).alias("_i", "cells"))
        return rows.select("_path", (F.col("_i") + 1).cast("bigint").alias("row_1based"), "cells")
    split = F.col("_metadata.file_block_start").alias("_split")
    texts = spark.read.text(paths).select(path, split, F.monotonically_increasing_id().alias("_place"), "value")
    numbered = sequence.ordinal(texts.filter(F.trim("value") != ""), ["_path"], ["_place"], "_split", "_row")
    cells = F.from_json("value", CELLS, {"mode": "FAILFAST"})
    return numbered.select("_path", (F.col("_row") + 1).alias("row_1based"), _lone_elements(cells).alias("cells"))


def has_cell(name: str) -> Column:
    return F.exists(F.map_keys("cells"), lambda k: F.lower(k) == name.lower())


def cell(name: str) -> Column:
    """The cell of that name: exact spelling first, then any letter case."""
    other = F.map_values(F.map_filter("cells", lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.col("cells")[name], F.get(other, F.lit(0)))


def needed(name: str) -> Column:
    """A cell that every row must have."""
    return F.when(has_cell(name), cell(name)).otherwise(
        F.raise_error(F.concat(F.lit(f"no column {name} in "), "_path")).cast("string")
    )


def needed_time(name: str) -> Column:
    """A time that must be readable."""
    at = times.parse_utc(needed(name))
    message = F.concat(F.lit(f"unreadable {name} in "), "_path", F.lit(", row "), F.col("row_1based").cast("string"))
    return F.when(at.isNotNull(), at).otherwise(F.raise_error(message).cast("timestamp"))


def read_index_tables(spark: SparkSession, paths: str | Sequence[str], *, lines: bool = False) -> DataFrame:
    """Index tables of any number of sensors and sets as typed records, in one scan.

    Set and sensor come from the path ``<set>/TABLE_<sensor>_SETn.json``. A row without one of the
    needed columns, with an unreadable time or without row numbers fails the read; other cells
    that are no numbers are NULL.
    """
    rows = read_json_rows(spark, paths, INDEX_WRAPPERS, lines=lines)
    path = F.col("_path")
    sensor = sensor_from_file(F.element_at(F.split(path, "/"), -1))
    measures = [f.name for f in schema.INDEX_COLUMNS.fields if isinstance(f.dataType, T.DoubleType)]
    return rows.select(
        F.element_at(F.split(path, "/"), -2).alias("set_name"),
        F.substring_index(sensor, "_", 1).alias("deck"),
        sensor.alias("sensor_name"),
        needed("File").alias("raw_file"),
        F.col("row_1based").alias("table_row"),
        cell("Record_UID").try_cast("double").cast("bigint").alias("record_uid"),
        numbers.to_int(needed("Start_Row").try_cast("double"), "Start_Row").alias("start_row_1based"),
        numbers.to_int(needed("End_Row").try_cast("double"), "End_Row").alias("end_row_1based"),
        needed_time("Start_Time").alias("start_time_utc"),
        needed_time("End_Time").alias("end_time_utc"),
        *[
            numbers.to_number(cell(c)).alias("range_value" if c == "Range" else c.lower())
            for c in measures
        ],
        cell("Tag").alias("tag"),
    )


def read_waveforms(
    spark: SparkSession, paths: str | Sequence[str], sensor_name: str | None = None, *, lines: bool = False
) -> DataFrame:
    """Raw waveform files of any number of sensors in one scan: typed time and value.

    Set, sensor and file come from the path ``<set>/<sensor>/<file>``, the sensor from
    ``sensor_name`` if given. The value is the cell under the sensor's own name if the row has it,
    else the first that is not the time. Times and values that cannot be read are NULL; a row
    without a time column or without any other fails the read.
    """
    rows = read_json_rows(spark, paths, WAVEFORM_WRAPPERS, lines=lines)
    tokens = F.split("_path", "/")
    sensor = F.lit(sensor_name) if sensor_name else F.element_at(tokens, -2)
    others = F.map_filter("cells", lambda k, _: F.lower(k) != "timestamp")
    first = F.get(F.map_values(others), F.lit(0))
    no_value = F.raise_error(F.concat(F.lit("no value column in "), "_path")).cast("string")
    value = (
        F.when(F.size(others) == 0, no_value)
        .when(F.array_contains(F.map_keys(others), sensor), F.element_at(others, sensor))
        .otherwise(first)
    )
    return rows.select(
        F.element_at(tokens, -3).alias("set_name"),
        sensor.alias("sensor_name"),
        F.element_at(tokens, -1).alias("raw_file"),
        "row_1based",
        times.parse_utc(needed("timestamp")).alias("timestamp_utc"),
        value.try_cast("double").alias("value"),
    )


def split_list(text: Column) -> Column:
    """``;``-separated text as a list without empty parts; NULL gives an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: p != "")


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """Event catalogue written as CSV with ``;`` lists."""
    raw = spark.read.option("header", True).csv(path)
    lists = {"active_sensors", "excluded_sensors", "excluded_sensor_reasons"}
    with_lists = raw.withColumns({c: split_list(F.col(c)) for c in lists if c in raw.columns})
    timed = with_lists.withColumns(
        {c: times.parse_utc(F.col(c)) for c in ("start_time_utc", "end_time_utc") if c in raw.columns}
    )
    return schema.conform(timed, schema.EVENTS)


def read_sample_csv(spark: SparkSession, path: str, *, set_name: str, deck: str) -> DataFrame:
    """Wide sample export of one set and deck (CSV or CSV.GZ), as long rows without gaps."""
    wide = spark.read.option("header", True).csv(path)
    keys = ["event_id", "sample_index", "timestamp_utc"]
    sensors = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, sensors, "sensor_name", "value")
    value = F.col("value").try_cast("double")
    return (
        long.select(
            "event_id",
            F.lit(set_name).alias("set_name"),
            F.lit(deck).alias("deck"),
            "sensor_name",
            F.col("sample_index").cast("bigint").alias("sample_index"),
            times.parse_utc(F.col("timestamp_utc")).alias("timestamp_utc"),
            value.alias("value"),
        )
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def read_sensor_map(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The channel map from the first of ``paths`` that exists."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        if location.getFileSystem(conf).exists(location):
            return spark.read.option("header", True).csv(path)
    raise FileNotFoundError(f"no sensor map at any of {list(paths)}")
