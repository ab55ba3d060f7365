"""Secrets by their form, and by what they add to a zstandard frame primed with code."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwave.llm.storage import Batches, as_bytes, packed, quoted, unpacked, with_fields

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGNED = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ACCESS = 16
HEX = re.compile(r"[0-9a-f]{32,}")

#: Words that make what follows sensitive.
SENSITIVE_WORDS = ("auth", "bearer", "credential", "private", "passphrase", "pwd", "key", "session", "signature", "secret", "token", "passw")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
REACH = 48  # code points between a sensitive word and the end of the gap before its candidate
BEFORE, AFTER = 1000, 200  # code points of surrounding text that prime the frame
MIN_NOVELTY = 0.5  # marginal compressed bytes for each byte of the candidate

#: Fixed list of common code words and identifiers, the frame's first dictionary.
IDENTIFIERS = (
    "abstract argument array assert async await authorization background base64 boolean bearer break buffer cache "
    "callback case catch certificate char class client command config configuration connection const constructor "
    "container content context continue controller cookie count create credential database debug decode default "
    "delete description development directory document double element else encode encoding endpoint enum "
    "environment error event exception export extends false final finally float for format from function get global "
    "handler hash header host html http https identifier identity if implements import index info init input insert "
    "instance int integer interface internal item iterator json key length lambda level library license list listener "
    "local localhost login logger long main manager map message metadata method model module name namespace network "
    "new none null number object option output override package parameter parse password path payload permission "
    "pointer policy port prefix print private process production profile property protected protocol provider proxy "
    "public query queue random record redirect reference register release remote render repository request resource "
    "response result return role route runtime schema script secret secret_key self server service session setting "
    "short signature size socket source stack static status stream string struct style super switch system table "
    "target template test text thread throw timeout timestamp title token transaction true try type undefined unique "
    "unsigned update upload url user username utf-8 value variable vector version view void volatile while window "
    "worker write xml yaml zone access_token api_key apikey client_id client_secret private_key public_key user_id"
)
LEVEL = 3


def priming() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, place of kind, end)`` of the three fixed forms."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novelty(text: str, start: int, end: int, frame: zstandard.ZstdCompressor) -> float:
    """Marginal compressed bytes of ``text[start:end]`` after its surroundings, for each of its bytes."""
    around = (text[max(0, start - BEFORE) : start] + text[end : end + AFTER]).encode("utf-8", "replace")
    own = text[start:end].encode("utf-8", "replace")
    return (len(frame.compress(around + b" " + own)) - len(frame.compress(around))) / len(own)


def novel_spans(text: str, taken: list[tuple[int, int, str]], frame: zstandard.ZstdCompressor, least: float) -> list[tuple[int, int, int]]:
    """Incompressible ones of all candidates shortly after a sensitive word, outside ``taken``; each is measured once."""
    found, done = [], 0
    starts = [s for s, _, _ in taken]
    reached = list(accumulate((e for _, _, e in taken), max))
    for word in SENSITIVE.finditer(text):
        last = min(len(text), word.end() + REACH + 16)
        while at := CANDIDATE.search(text, max(done, word.end()), last):
            start = at.start()
            end = done = CANDIDATE.match(text, start).end()
            before = bisect_left(starts, end)
            if before and reached[before - 1] > start:
                continue
            if novelty(text, start, end, frame) >= least:
                found.append((start, 3, end))
    return found


def scan(text: str, frame: zstandard.ZstdCompressor, least: float) -> list[tuple[int, int, int]]:
    """All spans by start, then kind as listed."""
    spans = base_spans(text)
    low = text.lower()
    if any(w in low for w in SENSITIVE_WORDS):
        spans = sorted(spans + novel_spans(text, spans, frame, least))
    return spans


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scan:
    """The task side, with its threshold."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, batches: Batches) -> Batches:
        frame = priming()
        for batch in batches:
            column = []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                spans = scan(raw.decode("utf-8", "replace"), frame, self.least)
                column.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(column, SPAN)], [*batch.schema.names[:-1], "secrets"]
            )


def find_secrets(docs: DataFrame, text_col: str = "text", min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """The columns of ``docs`` but its text, with ``secrets array<struct<kind, start, end>>``.

    ``assign``, ``access`` and ``hex`` are fixed forms, by leftmost non-overlapping matches;
    ``novel`` are further strings in a sensitive context whose marginal compressed size, after the
    text around them and a dictionary of identifiers, is at least ``min_novelty`` of their bytes.
    Offsets are code points, ends exclusive, in order of start and then kind.

    Null and empty texts have none. Every row is scanned by itself, repeated rows too. An input
    column named ``secrets`` is replaced.
    """
    lost = ("secrets", text_col)
    rows = docs.select(packed(docs, *lost).alias("given"), as_bytes(quoted(text_col)).alias("body"))
    found = rows.mapInArrow(Scan(min_novelty), with_fields(rows, "secrets array<struct<kind:string,start:long,end:long>>"))
    return found.select(*unpacked(docs, F.col("given"), *lost), "secrets")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed forms, SHA-256 of their spans, and all spans as text."""
    fixed = F.filter("secrets", lambda s: s["kind"] != "novel")
    counts = [count_of("secrets", k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        quoted(id_col), *counts, F.sha2(joined(fixed), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
