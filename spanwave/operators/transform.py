"""Fourier transforms of waveforms longer than a task should hold, in n log n.

A transform of any length N is a convolution with a chirp, and that takes transforms of a power of two
M >= 2N. Such a transform is split: M = R * Q, sample number n = R * q + r. Each r is transformed over
q (tasks hold Q numbers), turned by its phase and cut into blocks of frequencies; each block of all r
is transformed over r (tasks hold 2^15 numbers). There the product with the chirp's transform is taken
and the way back begins: over r in the same task, then over q for each r. Three shuffles of the
waveform, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 15  # complex numbers of one block in a task

Batches = Iterator[pa.RecordBatch]


def grid(n: int) -> tuple[int, int, int]:
    """Rows R, columns Q and columns of a block for a transform of length ``n``."""
    bits = max(2, (2 * n - 1).bit_length())
    columns = 1 << (bits + 1) // 2
    rows = (1 << bits) // columns
    return rows, columns, max(1, min(columns, CELLS // rows))


def chirp(at: np.ndarray, n: int, sign: int) -> np.ndarray:
    """``exp(sign * i * pi * at^2 / n)``, the angle reduced in whole numbers."""
    return np.exp(sign * 1j * np.pi * ((at * at) % (2 * n)) / n)


def _phase(row: int, columns: np.ndarray, size: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((row * columns) % size) / size)


def _parts(values: np.ndarray) -> list[pa.Array]:
    """Rows of complex numbers as list columns of the real and the imaginary parts."""
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(p).ravel())) for p in (values.real, values.imag)]


def _complex(rows: pa.StructArray, width: int) -> np.ndarray:
    re, im = (rows.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("re", "im"))
    return (re + 1j * im).reshape(-1, width)


def _groups(column: pa.ListArray) -> Iterator[pa.StructArray]:
    for i in range(len(column)):
        yield column.slice(i, 1).flatten()


def _with(batch: pa.RecordBatch, keys: list[str], counts: list[int], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
    return pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keys] + columns, [*keys, *names])


def _blocks_of(line: np.ndarray, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    blocks = line.reshape(-1, width)
    return np.full(len(blocks), row, np.int64), blocks


def long_transform(samples: DataFrame, keys: Sequence[str], n: int, low: int, high: int) -> DataFrame:
    """Bins ``low`` to ``high`` of the zero-padded transform of length ``n`` of each waveform.

    ``samples`` holds ``keys, sample_index, value``; the result ``keys, bin, magnitude``. Samples from ``n`` on
    are left out.
    """
    rows, columns, width = grid(n)
    size, spark, keys = rows * columns, samples.sparkSession, list(keys)
    kinds = samples.select(*keys).schema.fields
    block_fields = T.StructType([*kinds, *T.StructType.fromDDL("r long, block long, re array<double>, im array<double>").fields])
    every = np.arange(columns)

    def forward(batches: Batches) -> Batches:
        """Transform one residue over its samples: all its blocks."""
        for batch in batches:
            places, lines = [], []
            for r, got in zip(batch.column("r").to_pylist(), _groups(batch.column("x")), strict=True):
                line = np.zeros(columns, complex)
                q = got.field("q").to_numpy()
                line[q] = got.field("v").to_numpy(zero_copy_only=False) * chirp(q * rows + r, n, -1)
                place, blocks = _blocks_of(np.fft.fft(line) * _phase(r, every, size, -1), r, width)
                places.append(place)
                lines.append(blocks)
            if lines:
                numbers = [pa.array(np.concatenate(places)), pa.array(np.tile(np.arange(columns // width), len(lines)))]
                yield _with(batch, keys, [columns // width] * len(lines), numbers + _parts(np.concatenate(lines)), ["r", "block", "re", "im"])

    def chirp_rows(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                at = every * rows + r
                back = np.minimum(at, size - at)
                line = np.where(back < n, chirp(back, n, 1), 0)
                place, blocks = _blocks_of(np.fft.fft(line) * _phase(r, every, size, -1), r, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), pa.array(np.arange(columns // width)), *_parts(blocks)], ["r", "block", "re", "im"]
                )

    def there_and_back(batches: Batches) -> Batches:
        """A block of all residues: transform, multiply by the chirp's, begin the way back."""
        for batch in batches:
            numbers, lines, counts = [], [], []
            both = zip(batch.column("block").to_pylist(), _groups(batch.column("x")), _groups(batch.column("c")), strict=True)
            for block, got, other in both:
                x, c = (np.zeros((rows, width), complex) for _ in range(2))
                for into, part in ((x, got), (c, other)):
                    into[part.field("r").to_numpy()] = _complex(part, width)
                product = np.fft.ifft(np.fft.fft(x, axis=0) * np.fft.fft(c, axis=0), axis=0)
                at = block * width + np.arange(width)
                turn = np.exp(2j * np.pi * ((np.arange(rows)[:, None] * at[None]) % size) / size)
                lines.append(product * turn)
                numbers.append(np.full(rows, block, np.int64))
                counts.append(rows)
            if lines:
                r = pa.array(np.tile(np.arange(rows), len(lines)))
                yield _with(batch, keys, counts, [r, pa.array(np.concatenate(numbers)), *_parts(np.concatenate(lines))], ["r", "block", "re", "im"])

    def finish(batches: Batches) -> Batches:
        for batch in batches:
            bins, sizes, counts = [], [], []
            for r, got in zip(batch.column("r").to_pylist(), _groups(batch.column("x")), strict=True):
                line = np.zeros((columns // width, width), complex)
                line[got.field("block").to_numpy()] = _complex(got, width)
                at = every * rows + r
                inside = (at >= low) & (at <= high)
                # The chirp before the sum has absolute value one.
                sizes.append(np.abs(np.fft.ifft(line.ravel()))[inside])
                bins.append(at[inside])
                counts.append(int(inside.sum()))
            if bins:
                yield _with(batch, keys, counts, [pa.array(np.concatenate(bins)), pa.array(np.concatenate(sizes))], ["bin", "magnitude"])

    place = F.col("sample_index")
    cut = (
        samples.filter((place >= 0) & (place < n))
        .groupBy(*keys, F.pmod(place, F.lit(rows)).cast("long").alias("r"))
        .agg(F.collect_list(F.struct(F.floor(place / F.lit(rows)).alias("q"), F.coalesce(F.col("value"), F.lit(float("nan"))).alias("v"))).alias("x"))
    )
    packed = F.collect_list(F.struct("r", "re", "im"))
    turned = cut.mapInArrow(forward, block_fields).groupBy(*keys, "block").agg(packed.alias("x"))
    other = _chirp_table(spark, rows, chirp_rows).groupBy("block").agg(packed.alias("c"))
    back = turned.join(other, "block").mapInArrow(there_and_back, block_fields)
    lines = back.groupBy(*keys, "r").agg(F.collect_list(F.struct("block", "re", "im")).alias("x"))
    return lines.mapInArrow(finish, T.StructType([*kinds, *T.StructType.fromDDL("bin long, magnitude double").fields]))


def _chirp_table(spark: SparkSession, rows: int, build) -> DataFrame:
    return spark.range(rows).mapInArrow(build, "r long, block long, re array<double>, im array<double>")
