"""Removal of repeated byte strings: repeated intervals of merged Burrows-Wheeler transforms.

A string of ``length`` bytes is repeated if it also starts earlier (smaller id, or same id and
smaller start); every byte of a repeated string goes.

1. Texts equal as a whole: all but the first are repeated throughout.
2. Each string chooses an anchor by its bytes alone: the smallest hash among its runs of
   ``ANCHOR`` bytes. Neighbouring strings with one anchor that lie left, or right, of it form a
   unit; all strings of a unit hold one core of some two thirds of their length, so equal strings are
   in units with equal cores. A Bloom pair over cores lets only units through whose core may repeat.
3. Equal units: all but the first are repeated throughout.
4. Different units with one core are brought together. Each task takes them core by core in
   groups of a few shards, cuts off the ends where no string has the hash of another place's, sorts the suffixes of each shard and takes its transform. The shards of a
   group are merged by refining their interleave: after h rounds it is right for the first h bytes,
   and the round in which a boundary first shows gives the common prefix. After ``length`` rounds
   the intervals without a boundary are the repeated strings; suffixes are never sorted again.
   Strings of a core with more than ``BLOCK`` units are grouped one by one, by their bytes, instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from spanwave.llm import bloom
from spanwave.llm.storage import Batches, as_bytes, discard, numbers, quoted, stage

LENGTH = 100
ANCHOR = 32
PIECE = 1 << 18  # bytes worked on at once
PLACE_BITS = 22
BLOCK = 20_000  # units of one core that may meet in one task
SHARD_BYTES = 1 << 16
MERGED = 4  # shards merged at once; units of one core stay together even if they are more
TASK_BYTES = 4 << 20
MAX_SENT = 1_000_000  # ids that may be sent to all tasks; more are joined

_random = np.random.RandomState(7041)
BYTE = _random.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)]).astype(np.uint64)


class Rolling:
    """Hashes of all runs of some width, by differences of one cumulative sum."""

    def __init__(self) -> None:
        self.up, self.down = _powers(BASE, 1), _powers(BASE_INVERSE, 1)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(raw):
            self.up, self.down = (_powers(b, len(raw) + 1) for b in (BASE, BASE_INVERSE))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * self.up[: len(raw)], out=total[1:])
        return total

    def runs(self, total: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        h = (total[stop] - total[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in runs of about ``PIECE`` bytes: the bytes, and row, offset and end of each part.

    Long texts come in parts that overlap by one byte less than a string.
    """
    parts: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    held = 0

    def packed():
        ends = np.cumsum([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(offsets), ends

    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, max(1, len(text) - length + 1), PIECE - length + 1):
            part = text[at : at + PIECE]
            if held and held + len(part) > PIECE:
                yield packed()
                parts, rows, offsets, held = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(at)
            held += len(part)
    if parts:
        yield packed()


def units(texts: list[bytes], length: int, rolling: Rolling) -> Iterator[tuple]:
    """Units of all texts: ``raw, row, start in raw, stop in raw, offset in text, core hash`` per piece."""
    width = length - ANCHOR + 1
    half = width // 2
    for raw, rows, offsets, ends in pieces(texts, length):
        total = rolling.sums(raw)
        n = len(raw) - ANCHOR + 1
        hashes = rolling.runs(total, slice(0, n), slice(ANCHOR, ANCHOR + n))
        ordered = (hashes << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        anchor = (sliding_min(ordered, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.arange(len(anchor), dtype=np.int64)  # starts of strings
        begins = np.concatenate([[0], ends[:-1]])
        part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
        inside = first + length <= ends[part]
        first, anchor, part = first[inside], anchor[inside], part[inside]
        if not len(first):
            continue
        right = anchor - first < half  # the string lies right of its anchor
        new = np.ones(len(first), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1]) | (first[1:] != first[:-1] + 1)
        at = np.flatnonzero(new)
        last = first[np.concatenate([at[1:], [len(first)]]) - 1]
        start, anchor, right, part = first[at], anchor[at], right[at], part[at]
        # The bytes that every string of the half holds, whatever its distance from the anchor.
        core_start = np.where(right, anchor, anchor - half)
        core_stop = np.where(right, anchor + length - half + 1, anchor + length - (width - 1))
        core = rolling.runs(total, core_start, core_stop) ^ right.astype(np.uint64)
        yield raw, rows[part], start, last + length, offsets[part] + start - begins[part], core


def _fill(batches: Batches, bits: int, length: int) -> Batches:
    rolling = Rolling()
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    hashed = (u[5] for b in batches for u in units(b.column(0).to_pylist(), length, rolling))
    for rows in bloom.fill(hashed, bits):
        yield pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)


def _suspects(batches: Batches, filled, length: int) -> Batches:
    rolling = Rolling()
    for batch in batches:
        for raw, row, start, stop, offset, core in units(batch.column(2).to_pylist(), length, rolling):
            keep = np.flatnonzero(bloom.may_repeat(core, filled.value))
            whole = raw.tobytes()
            bodies = [whole[a:b] for a, b in zip(start[keep].tolist(), stop[keep].tolist(), strict=True)]
            of = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of),
                    batch.column(1).take(of),
                    pa.array(offset[keep]),
                    pa.array(core[keep].view(np.int64)),
                    pa.array([xxh3_128_digest(b) for b in bodies], pa.binary()),
                    pa.array(bodies, pa.binary()),
                ],
                ["owner", "print", "at", "core", "unit", "bytes"],
            )


def first_symbols(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per suffix its first symbols in one number, the symbols up to its end, and how many the number holds."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    bits = 8 * text.itemsize
    span = 64 // bits
    key = np.zeros(n, np.uint64)
    for i in range(span):
        at = np.zeros(n, np.uint64)
        at[: n - i] = text[i:]
        at[left < i] = 0  # what follows an end does not count
        key |= at << np.uint64(64 - bits * (i + 1))
    return key, left, span


def sort_shard(key: np.ndarray, left: np.ndarray, span: int) -> np.ndarray:
    """Suffixes of strings by doubling ranks, from their first symbols; of equal suffixes the earlier string's first."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.zeros(n, np.int64)
    # Ends differ from each other, so a suffix that has one in reach has a rank of its own.
    np.cumsum((ordered[1:] != ordered[:-1]) | (left[order[1:]] < span), out=fresh[1:])
    rank = np.empty(n, np.int64)
    rank[order] = fresh
    while fresh[-1] != n - 1:
        following = np.zeros(n, np.int64)
        following[:-span] = rank[span:] + 1
        pair = rank * np.int64(n + 1) + following
        order = np.argsort(pair)
        ordered = pair[order]
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        rank[order] = fresh
        span *= 2
    return order


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the symbols in order, of equal ones the earlier first."""
    if symbols.itemsize > 1 or len(symbols) > 1 << 24:
        return np.argsort(symbols, kind="stable")
    key = symbols.astype(np.uint32) << np.uint32(24)
    key |= np.arange(len(symbols), dtype=np.uint32)
    key.sort()
    key &= np.uint32((1 << 24) - 1)
    return key.astype(np.intp)


def merge(text: np.ndarray, cuts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the shards ``text[cuts[i]:cuts[i + 1]]`` in order of their first ``length`` symbols.

    With it the common prefix of each suffix with the one before it, exact below ``length``. The
    interleave starts from the first few symbols and is kept as places in the row of all shards'
    sorted suffixes. One round takes the
    symbols before the suffixes (the transforms, interleaved), sorts them stably and goes on to the
    suffixes that these symbols begin; ends keep the order of their strings.
    """
    n = len(text)
    key, left, span = first_symbols(text)
    sorted_suffixes = np.concatenate(
        [sort_shard(key[a:b], left[a:b], span) + a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    )
    place = np.empty(n, np.int32)
    place[sorted_suffixes] = np.arange(n, dtype=np.int32)
    before = np.concatenate([text[-1:], text[:-1]])[sorted_suffixes]  # the shards' transforms
    step = np.concatenate([place[-1:], place[:-1]])[sorted_suffixes]  # where the suffix one symbol longer is
    ends = place[np.flatnonzero(text == 0)]
    strings = len(ends)
    # The sorted shards are first merged by the symbols that one number holds.
    key, left = key[sorted_suffixes], left[sorted_suffixes]
    row = np.argsort(key, kind="stable").astype(np.int32)
    key, left = key[row], left[row]
    differ = key[1:] ^ key[:-1]
    edge = np.ones(n, bool)
    edge[1:] = (differ != 0) | (left[1:] < span)
    common = np.full(n, length, np.int16)
    common[0] = 0
    in_bytes = differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    equal = np.where(differ == 0, span, in_bytes.argmax(axis=1) // text.itemsize)
    common[1:][edge[1:]] = np.minimum(np.minimum(equal, left[1:]), left[:-1])[edge[1:]]
    block = np.cumsum(edge, dtype=np.int32)
    for h in range(span + 1, length + 1):
        symbols = before.take(row)
        order = stable_order(symbols)[strings:]
        ordered, blocks = symbols.take(order), block.take(order)
        longer = step.take(row.take(order))
        edge[strings + 1 :] = (ordered[1:] != ordered[:-1]) | (blocks[1:] != blocks[:-1])
        fresh = np.cumsum(edge, dtype=np.int32)
        if fresh[-1] != block[-1]:
            common[edge & (common == length)] = h - 1
        unchanged = fresh[-1] == block[-1] and np.array_equal(row[strings:], longer)
        row[:strings], row[strings:] = ends, longer
        block = fresh
        if unchanged:
            break
    return sorted_suffixes[row], common


def worth_merging(bodies: list[bytes], length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The parts of ``bodies`` that may hold a repeated string: body, offset in it, bytes.

    A part reaches from the first to the last string of a body whose hash another place has too.
    """
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    body = np.repeat(np.arange(len(bodies)), np.diff(ends, prepend=0))
    start = np.flatnonzero(np.arange(length, len(raw) + length) <= ends[body])
    hashes = rolling.runs(rolling.sums(raw), start, start + length)
    order = np.argsort(hashes)
    equal = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(start), bool)
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    start = start[twice]
    of, first, counts = np.unique(body[start], return_index=True, return_counts=True)
    starts, stops = start[first], start[first + counts - 1] + length
    whole = raw.tobytes()
    return of, starts - (ends - np.diff(ends, prepend=0))[of], [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def repeated(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings that two or more places of ``bodies`` hold: interval number, body, offset of each place."""
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    used = np.zeros(257, bool)
    used[raw.astype(np.int64) + 1] = True
    text = raw.astype(np.uint16) + np.uint16(1)
    text[begins[1:] - 1] = 0
    if not used[256]:  # one byte a symbol sorts faster; 255 does not occur in UTF-8
        text = text.astype(np.uint8)
    count = max(2, -(-len(text) // SHARD_BYTES))
    cuts = np.unique(np.searchsorted(begins, np.linspace(0, len(text), count + 1)))
    if len(cuts) == 2 and len(bodies) > 1:
        cuts = np.array([0, len(bodies) // 2, len(bodies)])
    suffixes, common = merge(text, begins[cuts], length)
    interval = np.cumsum(common < length)
    chosen = np.flatnonzero(np.bincount(interval)[interval] > 1)
    suffixes, interval = suffixes[chosen], interval[chosen]
    body = np.searchsorted(begins, suffixes, side="right") - 1
    offset = suffixes - begins[body]
    whole = sizes[body] - 1 - offset >= length
    return interval[whole], body[whole], offset[whole]


def groups(batches: Batches) -> Iterator[pa.Table]:
    """Rows of whole cores, of about ``MERGED`` shards together; the rows come ordered by core."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cores = numbers(batch, "core")
        lengths = pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(cores[1:] != cores[:-1]) + 1, len(cores)]
        if held and numbers(held[-1], "core")[-1] != cores[0]:
            cuts = [0, *cuts]
        done = 0
        sums = np.concatenate([[0], np.cumsum(lengths)])
        for cut in cuts[:-1]:
            if size + sums[cut] - sums[done] >= MERGED * SHARD_BYTES:
                yield pa.Table.from_batches([*held, batch.slice(done, cut - done)])
                held, size, done = [], 0, cut
        held.append(batch.slice(done))
        size += sums[-1] - sums[done]
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Batches, length: int) -> Batches:
    """Places of repeated strings in the units of a task, but the first place of each."""
    rolling = Rolling()
    for table in groups(batches):
        if (rows := later_places(table, length, rolling)) is not None:
            yield rows


def later_places(table: pa.Table, length: int, rolling: Rolling) -> pa.RecordBatch | None:
    if table.num_rows < 2:
        return None
    of, shift, parts = worth_merging(table.column("bytes").to_pylist(), length, rolling)
    if not parts:
        return None
    interval, part, offset = repeated(parts, length)
    if not len(interval):
        return None
    body, offset = of[part], offset + shift[part]
    owners = table.column("owner").combine_chunks()
    known = owners.dictionary_encode()
    ranks = pc.rank(known.dictionary, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
    rank = ranks[known.indices.to_numpy(zero_copy_only=False)][body]
    at = table.column("at").to_numpy()[body] + offset
    order = np.lexsort((at, rank, interval))
    i, r, a = interval[order], rank[order], at[order]
    lead = np.concatenate([[True], i[1:] != i[:-1]])
    group = np.cumsum(lead) - 1
    later = (r != r[lead][group]) | (a != a[lead][group])
    rows = body[order][later]
    at = a[later]
    # Runs of neighbouring strings of one unit become one span.
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    if not len(rows):
        return None
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] > at[:-1] + length)])
    starts = np.flatnonzero(new)
    stops = at[np.concatenate([starts[1:], [len(at)]]) - 1] + length
    of = pa.array(rows[starts])
    return pa.RecordBatch.from_arrays(
        [owners.take(of), table.column("print").combine_chunks().take(of), pa.array(at[starts]), pa.array(stops)],
        ["owner", "print", "start", "stop"],
    )


def _windows(batches: Batches, length: int) -> Batches:
    """Every string of a unit as a row of its own."""
    for batch in batches:
        bodies = batch.column("bytes").to_pylist()
        strings = [b[i : i + length] for b in bodies for i in range(len(b) - length + 1)]
        counts = np.array([len(b) - length + 1 for b in bodies], np.int64)
        of = pa.array(np.repeat(np.arange(len(bodies)), counts))
        shift = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, np.int64)
        at = numbers(batch.select(["at"]).take(of), "at") + shift
        yield pa.RecordBatch.from_arrays(
            [batch.column("owner").take(of), batch.column("print").take(of), pa.array(at, pa.int64()), pa.array(strings, pa.binary())],
            ["owner", "print", "at", "bytes"],
        )


def later_strings(windows: DataFrame, length: int) -> DataFrame:
    """``owner, print, start, stop`` of every string of ``windows`` but the first place of each.

    Equal strings are counted inside the tasks before they meet, by their bytes; the places then meet
    one row for each string, so that no task holds the places of a string at once.
    """
    firsts = (
        windows.groupBy("bytes")
        .agg(F.min(F.struct("owner", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("bytes", "first")
    )
    later = (F.col("owner") != F.col("first.owner")) | (F.col("at") != F.col("first.at"))
    return windows.join(firsts, "bytes").where(later).select("owner", "print", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))


RESULT = (
    T.StructType()
    .add("n_bytes", T.LongType())
    .add("n_removed", T.LongType())
    .add("n_spans", T.LongType())
    .add("kept", T.BinaryType())
)


@F.pandas_udf(RESULT)
def _remove(body: pd.Series, whole: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    sizes, removed, spans, kept = [], [], [], []
    for text, all_of_it, a, b in zip(body, whole, starts, stops, strict=True):
        gone = np.zeros(len(text) + 1, bool)
        if all_of_it:
            gone[:-1] = True
        elif a is not None and len(a):
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, np.asarray(a, np.int64), 1)
            np.add.at(edge, np.asarray(b, np.int64), -1)
            gone = np.cumsum(edge) > 0
        sizes.append(len(text))
        removed.append(int(gone.sum()))
        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        kept.append(np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes() if removed[-1] else text)
    return pd.DataFrame({"n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept": kept})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay).

    Bytes covered by a string of ``length`` bytes that also starts earlier are removed; strings are
    judged on the input, never cross documents, and may overlap. ``n_spans`` counts the maximal
    removed runs.

    Null texts are empty; texts shorter than ``length`` lose nothing. Of places with one id and one
    start (rows that share an id) none is earlier than the other. Rows without an id lose nothing
    and count for nothing. Other columns are not read.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"strings need at least {2 * ANCHOR} bytes")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    body = as_bytes(quoted(text_col))
    source = docs.select(quoted(id_col).alias("owner"), F.xxhash64(body).alias("print"), body.alias("body"))
    large = source.where(F.octet_length("body") >= length).where("owner is not null")
    # 1. Whole copies. Two hashes and the length tell texts apart.
    named = stage(large.select("owner", "print", F.md5("body").alias("digest"), F.octet_length("body").alias("size")))
    firsts = stage(named.groupBy("digest", "print", "size").agg(F.min("owner").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = stage(
        named.join(firsts, ["digest", "print", "size"]).where("owner <> first").select("owner", "print").distinct()
    )
    few = copies.count() <= MAX_SENT
    sent = F.broadcast(copies) if few else copies
    single = large.join(sent, ["owner", "print"], "left_anti")
    # 2. Units whose core may repeat.
    size = named.agg(F.sum("size")).first()[0] or 0
    bits = bloom.bits_for(size // 16, 9)  # a unit for every 16 to 20 bytes
    pairs = single.select("body").mapInArrow(partial(_fill, bits=bits, length=length), bloom.SCHEMA)
    filled = bloom.twice_filter(pairs, bits, spark)
    found = stage(
        single.mapInArrow(
            partial(_suspects, filled=filled, length=length),
            f"owner {kind}, print long, at long, core long, unit binary, bytes binary",
        )
    )
    # 3. Equal units.
    place = F.struct("owner", "at", "print")
    distinct = stage(
        found.groupBy("unit").agg(F.min(place).alias("p"), F.min("core").alias("core"), F.min("bytes").alias("bytes"))
        .select("unit", "core", "bytes", F.col("p.owner").alias("owner"), F.col("p.at").alias("at"), F.col("p.print").alias("print"))
    )
    head = distinct.select(
        "unit", F.col("owner").alias("first"), F.col("at").alias("first_at"), F.col("print").alias("first_print")
    )
    same_place = (F.col("owner") == F.col("first")) & (F.col("at") == F.col("first_at"))
    placed = stage(
        found.select("owner", "print", "at", "unit", F.octet_length("bytes").alias("size"))
        .join(head, "unit")
        .where(~same_place | (F.col("print") != F.col("first_print")))
        .select("owner", "print", "at", "unit", "size", same_place.alias("tied"))
    )
    again = placed.where("not tied").select("owner", "print", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"))
    # Rows that share id, start and unit with the first place are first places too.
    tied = placed.where("tied").select("owner", "print", "at", "unit").distinct().join(distinct.select("unit", "core", "bytes"), "unit")
    discard(found)
    # 4. Different units with one core.
    cores = stage(distinct.groupBy("core").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    heads = distinct.select("owner", "print", "at", "core", "bytes")
    met = heads.unionByName(tied.drop("unit")).join(cores, "core")
    usual = met.where(F.col("held") <= BLOCK).drop("held")
    volume = distinct.join(cores.where(F.col("held") <= BLOCK), "core").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = int(max(spark.sparkContext.defaultParallelism, -(-volume // TASK_BYTES)))
    partly = (
        usual.repartition(tasks, "core")
        .sortWithinPartitions("core")
        .mapInArrow(partial(_compare, length=length), f"owner {kind}, print long, start long, stop long")
    )
    if not cores.where(F.col("held") > BLOCK).isEmpty():
        hot = met.where(F.col("held") > BLOCK).select("owner", "print", "at", "bytes")
        windows = hot.mapInArrow(partial(_windows, length=length), f"owner {kind}, print long, at long, bytes binary")
        partly = partly.unionByName(later_strings(windows, length))
    spans = (
        again.unionByName(partly)
        .groupBy("owner", "print")
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        .select(F.col("owner").alias("of"), F.col("print").alias("of_print"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    )
    spans = stage(spans)
    discard(distinct, placed, cores, named, firsts)
    # Only texts that lose a part meet their spans; copies lose all and the rest nothing.
    marks = copies.withColumn("part", F.lit(False)).unionByName(
        spans.select(F.col("of").alias("owner"), F.col("of_print").alias("print"), F.lit(True).alias("part"))
    )
    marked = source.join(F.broadcast(marks) if marks.count() <= MAX_SENT else marks, ["owner", "print"], "left")
    none = F.lit(None).cast("array<long>")
    untouched = marked.where("part is null or not part").select("owner", "body", F.col("part").isNotNull().alias("whole"), none.alias("starts"), none.alias("stops"))
    parts = marked.where("part").join(spans, (F.col("owner") == F.col("of")) & (F.col("print") == F.col("of_print")))
    cut = untouched.unionByName(parts.select("owner", "body", F.lit(False).alias("whole"), "starts", "stops"))
    done = cut.select(F.col("owner").alias(id_col), _remove("body", "whole", "starts", "stops").alias("r"))
    return done.select(quoted(id_col), "r.*")
