"""Quality rules of single texts, and removal of lines that too many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spanwave.llm.line_dedup import SPACE
from spanwave.llm.storage import Batches, list_of, packed, quoted, stage, unpacked, with_fields

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_LINE_DOCS = 10  # documents of a host that may always share a line
MAX_LINE_SHARE = 0.05  # share of a host's documents that may hold a line
MIN_WORDS_LEFT = 0.25  # share of a document's words outside such lines
MAX_HOSTS_SENT = 20_000  # hosts whose common lines are sent to all tasks; more are joined
MAX_HOSTS_HELD = 1000  # hosts whose lines a worker remembers
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*METRICS, "base_failed", "n_common_words", "n_lines_removed", "kept")
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.uint64)
    if len(codes) == len(words):
        return 0
    # Rank windows exactly by doubling: pairs of words, then of pairs, then of fours.
    span = 1
    while span < WINDOW:
        pair = ids[:-span] * np.uint64(len(words) + 1) + ids[span:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        span *= 2
    counts = np.bincount(ids.astype(np.int64))
    at = np.flatnonzero(counts[ids.astype(np.int64)] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def line_key(line: bytes) -> int:
    """Hash of a line, ends stripped and A-Z lower-cased."""
    return h - (1 << 64) if (h := xxh3_64_intdigest(line.strip(SPACE).lower())) >= 1 << 63 else h


def line_keys(raw: bytes) -> set[int]:
    """Keys of the distinct lines with a word."""
    return {line_key(line) for line in raw.split(b"\n") if not line.isspace() and line}


def measure(raw: bytes) -> list[int]:
    """The metrics of one text."""
    words = raw.split()
    bare = raw.translate(None, SPACE)
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            again += line in seen
            seen.add(line)
    return [len(words), code_points(bare), len(raw) - len(raw.translate(None, SYMBOLS)), again, repeat_words(words)]


def without_lines(raw: bytes, common: frozenset[int]) -> tuple[bytes, int, int]:
    """The text without its common lines, the words of these lines, and how many they are."""
    stay, n_words, n_lines = [], 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace() and line_key(line) in common:
            n_words += len(line.split())
            n_lines += 1
        else:
            stay.append(line)
    return (b"\n".join(stay) if n_lines else raw), n_words, n_lines


def _lines(batches: Batches) -> Batches:
    for batch in batches:
        rows = [line_keys(raw or b"") for raw in batch.column(1).to_pylist()]
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.array([x for r in rows for x in r], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), list_of(flat, lengths, pa.int64())], ["__host", "__lines"])


def _clean(batches: Batches) -> Batches:
    """Rows that end in the host's common lines and the text: the metrics, the text that stays, and what was removed."""
    held: dict[str, frozenset[int]] = {}
    for batch in batches:
        hosts = batch.column(batch.num_columns - 3).to_pylist()
        commons, bodies = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
        if len(held) > MAX_HOSTS_HELD:
            held.clear()
        metrics, stay, removed = [], [], []
        for i, (host, body) in enumerate(zip(hosts, bodies, strict=True)):
            if host not in held:
                held[host] = frozenset(commons[i].as_py() or ())
            raw = body or b""
            metrics.append(measure(raw))
            text, *counts = without_lines(raw, held[host]) if held[host] else (raw, 0, 0)
            stay.append(None if body is None else text)
            removed.append(counts)
        numbers = np.array([[*m, *r] for m, r in zip(metrics, removed, strict=True)], np.int64).reshape(len(bodies), len(METRICS) + 2)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-3], *[pa.array(c) for c in numbers.T.copy()], pa.array(stay, pa.binary())],
            [*batch.schema.names[:-3], *METRICS, "n_common_words", "n_lines_removed", "__text"],
        )


def score(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str | None = "source",
    min_line_docs: int = MIN_LINE_DOCS,
    max_line_share: float = MAX_LINE_SHARE,
    min_words_left: float = MIN_WORDS_LEFT,
) -> DataFrame:
    """The columns of ``docs``, its text without common lines, with the metrics, ``base_failed``,
    ``n_common_words``, ``n_lines_removed`` and ``kept``.

    A line (ends stripped, A-Z lower-cased, with at least one word) is common in a host when more
    documents hold it than ``min_line_docs`` and than ``max_line_share`` of the host's documents.
    Such lines are removed from every text, those of rejected documents too; ``n_common_words`` and
    ``n_lines_removed`` count what went. The metrics describe the text as given. A document is kept
    if it passes the base rules and at least ``min_words_left`` of its words are left.

    Every row is a document, repeated rows too. Null and empty texts have no words and fail; a null
    text stays null. Rows without a host share one unnamed host. Input columns named like the outputs
    are replaced.
    """
    lost = (text_col, *OUTPUTS)
    host = F.coalesce(quoted(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    body = quoted(text_col).cast("string").cast("binary")
    lines = docs.select(host.alias("__host"), body.alias("__body")).mapInArrow(_lines, "__host string, __lines array<long>")
    # More than the fixed limit first: what is left is small beside the lines, and so is the list of a
    # host, at most the lines of a document divided by max_line_share on average. A null line stands for the document.
    held = stage(
        lines.select("__host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "__lines")).alias("line"))
        .groupBy("__host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > min_line_docs) | F.col("line").isNull())
    )
    sizes = held.where("line is null").select("__host", F.col("n").alias("__docs"))
    common = stage(
        held.where("line is not null")
        .join(sizes, "__host")
        .where(F.col("n") > F.col("__docs") * F.lit(max_line_share))
        .groupBy("__host")
        .agg(F.collect_list("line").alias("__common"))
    )
    if common.count() <= MAX_HOSTS_SENT:
        common = F.broadcast(common)
    rows = docs.select(packed(docs, *lost).alias("given"), host.alias("__host"), body.alias("__body")).join(common, "__host", "left")
    rows = rows.select("given", "__host", "__common", "__body")
    numbers = ", ".join(f"{m} long" for m in (*METRICS, "n_common_words", "n_lines_removed"))
    done = rows.mapInArrow(_clean, with_fields(rows.select("given", "__body"), f"{numbers}, __text binary"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = (F.col("n_words") - F.col("n_common_words")) >= F.col("n_words") * F.lit(min_words_left)
    text = F.col("__text").cast("string").cast(docs.schema[text_col].dataType).alias(text_col)
    return done.select(
        *unpacked(docs, F.col("given"), *lost),
        text,
        *METRICS,
        failed.alias("base_failed"),
        "n_common_words",
        "n_lines_removed",
        (~failed & left).alias("kept"),
    )
