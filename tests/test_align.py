import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spanwave.operators import align, joins
from tests import reference_kernels

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def frame(spark, rows, tile_seconds):
    df = spark.createDataFrame(
        [(e, s, i, at(t), float(v)) for e, s, i, t, v in rows],
        "event_id string, slot int, sample_index bigint, timestamp_utc timestamp, value double",
    )
    return df.withColumn("tile", F.floor(F.unix_micros("timestamp_utc") / (tile_seconds * 1_000_000)))


@pytest.mark.parametrize(
    "reference, target, expected",
    [
        ([0, 1, 2], [-1, 0, 0.5, 2.5], [0, 1, 1, 3]),
        ([0, 0, 1], [0, 0.5], [2, 2]),
        ([2, 0, 1], [1.5], [3]),
        ([5, 6], [1, 2], [0, 0]),
    ],
)
@pytest.mark.parametrize("tile", [1, 1000])
def test_asof_places(spark, reference, target, expected, tile):
    def side(values):
        return frame(spark, [("e", 0, i, v, v) for i, v in enumerate(values)], tile)

    got = joins.asof_backward(side(reference), side(target), ["event_id"]).orderBy("sample_index")
    assert [r.reference_index for r in got.collect()] == expected
    assert reference_kernels.asof_places(reference, target) == expected


def test_aligned_example(spark):
    sensors = [([0, 1, 2, 3], [10, 21, 30, 40]), ([0.2, 1.2, 2.2], [1, 2, 3]), ([0.1, 2.1], [5, 7])]
    rows = [
        ("e", s, i, t, v) for s, (ts, vs) in enumerate(sensors) for i, (t, v) in enumerate(zip(ts, vs))
    ]
    out = align.align(frame(spark, rows, 60), 3).orderBy("timestamp_utc").collect()
    assert [list(r["values"]) for r in out] == [[10.0, 1.0, 5.0], [30.0, 3.0, 7.0]]
    assert [r.sample_index for r in out] == [0, 2]


def random_event(rng: random.Random, sensors: int):
    event = []
    for slot in range(sensors):
        if slot and rng.random() < 0.1:
            event.append(None)
            continue
        n = rng.randint(1, 14)
        times = sorted(rng.choice([rng.randint(0, 40), rng.uniform(0, 40)]) for _ in range(n))
        event.append(([round(t, 3) for t in times], [rng.randint(0, 999) for _ in times]))
    return event


@pytest.mark.parametrize("tile", [2, 7, 100])
def test_alignment_matches_literal_procedure(spark, tile):
    rng = random.Random(tile)
    events = {f"e{i:03d}": random_event(rng, rng.randint(1, 5)) for i in range(150)}
    rows = [
        (name, slot, i, t, v)
        for name, event in events.items()
        for slot, sensor in enumerate(event)
        if sensor is not None
        for i, (t, v) in enumerate(zip(*sensor))
    ]
    got: dict[str, list] = {}
    out = align.align(frame(spark, rows, tile), 5).orderBy("event_id", "timestamp_utc", "sample_index")
    for r in out.collect():
        seconds = (r.timestamp_utc.replace(tzinfo=timezone.utc) - START).total_seconds()
        got.setdefault(r.event_id, []).append((round(seconds, 3), list(r["values"])))
    for name, event in events.items():
        want = [
            (t, [float(v) if v is not None else None for v in vs] + [None] * (5 - len(vs)))
            for t, vs in reference_kernels.align(event)
        ]
        assert got.get(name, []) == want, (name, event)
