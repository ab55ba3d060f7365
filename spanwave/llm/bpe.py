"""Byte-level BPE: whole words through a minimal perfect hash, the rest merged with a heap.

The vocabulary is a file of ranks, read on the driver and broadcast (its size is that of the file,
bounded by ``MAX_VOCABULARY``). Each pre-token is looked up whole; only those outside the vocabulary
are merged: a heap of adjacent pairs over a doubly linked list of byte pieces, whose ranks are read
from a plain table.
"""

from __future__ import annotations

import base64
from array import array
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spanwave.llm.storage import Batches, as_bytes, list_of, packed, quoted, unpacked, with_fields

MAX_VOCABULARY = 2_000_000
MAX_ID = 1 << 24
BUCKET = 4  # keys a bucket of the perfect hash holds on average
MASK, LOW = (1 << 64) - 1, (1 << 32) - 1
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers of the slot hash
MEMO_WORDS = 1_000_000  # words a task remembers; then it forgets them all
MEMO_BYTES = 64  # longer words are not remembered
LATEST: list = []  # the coder a worker used last, with its memory


class PerfectHash:
    """Minimal perfect hash: n byte strings to 0..n-1, one displacement a bucket.

    The slot is a hash of the key's digest and its bucket's displacement. Buckets are placed from the
    largest down; those of one key take a free slot outright, stored as a negative displacement.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // BUCKET)
        low = np.array([xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = ((low >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        self.shift = [0] * self.buckets
        taken = np.zeros(n, bool)
        slots = np.zeros(n, np.int64)
        singles = []
        tries = np.arange(512, dtype=np.uint64)[:, None]
        for b in sorted(range(self.buckets), key=lambda i: -len(members[i])):
            own = members[b]
            if len(own) == 1:
                singles.append(b)
                continue
            if not len(own):
                break
            for start in range(0, 1 << 24, len(tries)):
                mixed = (low[own] ^ ((tries + np.uint64(start)) * np.uint64(STEP))) * np.uint64(MIX)
                at = ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                good = ~taken[at].any(axis=1)
                if len(own) > 1:
                    ranked = np.sort(at, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    self.shift[b] = start + int(hit[0])
                    slots[own] = at[hit[0]]
                    taken[at[hit[0]]] = True
                    break
            else:
                raise ValueError("no displacement found; are all keys distinct?")
        free = np.flatnonzero(~taken)
        for b, slot in zip(singles, free, strict=False):
            self.shift[b] = -int(slot) - 1
            slots[members[b][0]] = slot
        self.order = slots
        self.turn = [shift * STEP & MASK if shift >= 0 else shift for shift in self.shift]

    def slot(self, key: bytes) -> int:
        """The slot of ``key`` if it is one of the keys; any slot if not."""
        d = xxh3_64_intdigest(key)
        turn = self.turn[(d >> 32) % self.buckets]
        if turn < 0:
            return -turn - 1
        return ((d ^ turn) * MIX >> 32 & LOW) % self.n


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, lines))}
    if not all(0 <= rank < MAX_ID for rank in ranks.values()):
        raise ValueError(f"ranks in {path} must be at least 0 and below {MAX_ID}")
    if not 0 < len(ranks) <= MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens in {path}; at most {MAX_VOCABULARY}, at least one")
    missing = 256 - sum(bytes([b]) in ranks for b in range(256))
    if missing:
        raise ValueError(f"{missing} single bytes have no rank")
    return ranks


class Vocabulary:
    """What the tasks get: the perfect hash, and word and id by slot."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        words = list(ranks)
        self.pattern = pattern
        self.hash = PerfectHash(words)
        self.words: list[bytes] = [b""] * len(words)
        self.ids = [0] * len(words)
        for word, slot in zip(words, self.hash.order.tolist(), strict=True):
            self.words[slot], self.ids[slot] = word, ranks[word]
        self.ranks = ranks
        spelled: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            spelled[i] = word
        self.spelled = pa.array(spelled, pa.large_binary())  # by id

    def rank(self, word: bytes) -> int | None:
        slot = self.hash.slot(word)
        return self.ids[slot] if self.words[slot] == word else None


def pack(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers in a row."""
    return array("i", ids).tobytes()


class Coder(dict):
    """Words to the bytes of their 32-bit ids; remembers what it has worked out, within a bound."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.known = vocabulary.ranks.get
        self.two = [-1] * (1 << 16)  # ranks of all pairs of bytes
        for word, rank in vocabulary.ranks.items():
            if len(word) == 2:
                self.two[word[0] << 8 | word[1]] = rank
        self.split = regex.compile(vocabulary.pattern).findall

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        rank = self.vocabulary.rank(raw)
        ids = pack([rank] if rank is not None else self.merge(raw))
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary.

        A heap entry packs rank, start and end of a possible join into one number.
        """
        known, two, n = self.known, self.two, len(raw)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        end = list(range(1, n + 1))  # end[i]: where the piece that starts at i stops; 0 once joined to its left
        before = list(range(-1, n))
        heap = [
            (r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(zip(raw, raw[1:])) if (r := two[a << 8 | b]) >= 0
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop, i = entry & mask, entry >> bits & mask
            middle = end[i]
            if not middle or middle == n or end[middle] != stop:
                continue  # one of the two pieces has grown since
            end[i], end[middle] = stop, 0
            before[stop] = i
            if stop < n and (r := known(raw[i : end[stop]], -1)) >= 0:
                heappush(heap, (r << bits | i) << bits | end[stop])
            left = before[i]
            if left >= 0 and (r := known(raw[left:stop], -1)) >= 0:
                heappush(heap, (r << bits | left) << bits | stop)
        ids, i = [], 0
        while i < n:
            ids.append(known(raw[i : end[i]]))
            i = end[i]
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def _encode(batches: Batches, shared) -> Batches:
    vocabulary = shared.value
    if not LATEST or LATEST[0].vocabulary is not vocabulary:
        LATEST[:] = [Coder(vocabulary)]
    coder = LATEST[0]
    for batch in batches:
        parts = [coder.encode(text.decode("utf-8", "replace")) for text in batch.column(batch.num_columns - 1).to_pylist()]
        ids = list_of(
            np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64), pa.int32()
        )
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])


def _decode(batches: Batches, shared) -> Batches:
    spelled = shared.value.spelled
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        words = spelled.take(column.flatten())
        if words.null_count:
            raise ValueError("an id outside the vocabulary")
        # The words lie one after another, so a text is cut out of them by its first and last offset.
        cut = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
        offsets = np.frombuffer(words.buffers()[1], np.int64)[cut] if len(words) else np.zeros(len(cut), np.int64)
        texts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets), words.buffers()[2] or pa.py_buffer(b"")]
        )
        yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.binary())], [*batch.schema.names, "decoded"])


def load(spark, path: str, pattern: str):
    """The vocabulary of a rank file with its pre-token pattern, for all tasks."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(docs: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of a column of that name.

    Null and empty texts have no ids. Each match of the pattern is encoded by itself; strings of
    special tokens are ordinary text. Bytes that are not UTF-8 count as U+FFFD.
    """
    rows = docs.select(packed(docs, "ids").alias("given"), as_bytes(quoted(text_col)).alias("body"))
    done = rows.mapInArrow(partial(_encode, shared=vocabulary), with_fields(rows, "ids array<int>"))
    return done.select(*unpacked(docs, F.col("given"), "ids"), "ids")


def decode(encoded: DataFrame, vocabulary, ids_col: str = "ids") -> DataFrame:
    """Rows with ``decoded binary``, the bytes of ``ids_col``; null ids give no bytes, unknown ids fail."""
    lost = ("decoded", ids_col)
    rows = encoded.select(packed(encoded, *lost).alias("given"), quoted(ids_col).alias("ids"))
    done = rows.mapInArrow(partial(_decode, shared=vocabulary), with_fields(rows, "ids array<int>, decoded binary"))
    return done.select(*unpacked(encoded, F.col("given"), *lost), "ids", "decoded")


def digests(decoded: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids in decimal joined by a space, and of the decoded bytes."""
    return decoded.select(
        quoted(id_col),
        *[F.col("ids")] * keep_ids,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
