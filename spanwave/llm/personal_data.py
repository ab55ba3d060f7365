"""Personal data by fixed forms, and by contexts learned from them.

Fixed forms are the seeds. The words around a seed are a pattern; patterns and the identifier-like
strings they surround make a graph, scored in rounds on Spark: a pattern is as good as the share of
sure instances it surrounds, an instance as sure as its patterns together make it. Instances believed
after some rounds support patterns as seeds do, and the rounds are repeated until none is added.
Patterns of high confidence then point out identifiers that no fixed form matches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spanwave.llm.secret_scan import count_of, joined
from spanwave.llm.storage import Batches, as_bytes, packed, quoted, stage, unpacked, with_fields

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # numbers joined by dots; an address is the next four of them
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

TRIM = ".,;:!?\"'()[]{}<>*#$%&|"
MIN_TOKEN, MIN_DIGITS = 6, 4  # what an identifier-like string has at least
ROUNDS = 3  # of scoring, before the believed instances are taken over
SMOOTH = 2.0  # unsure instances that every pattern is charged with
MIN_SEEDS = 3  # different sure or believed instances a pattern needs
MIN_CONFIDENCE = 0.6
MIN_BELIEF = 0.6  # from which on a learned instance supports patterns
MAX_CONTEXT = 40  # code points of a context word that count
REACH = 80  # code points before and after a span that are searched for its context
EDGE, ANY = "|", "*"  # in a context: the text's edge, and a word that says nothing; no stripped word is one of them


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += DOUBLED[d] if i % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``EMAIL``: each tried once, from the start of the run of characters before its @."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            found.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(place of kind, start, end)`` of the four fixed forms."""
    found = [(0, *span) for span in emails(text)]
    if MARK.search(text) is None:
        return found
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in four)):
                found.append((1, at, end))
            at = end + 1
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def context(text: str, start: int, end: int) -> str:
    """The words next to a span, lower-cased; ``EDGE`` at a text's edges, ``ANY`` where digits stand or no word is in reach."""
    left = reversed(text[max(0, start - REACH) : start].lower().split())
    right = text[end : end + REACH].lower().split()
    a, b = (next((t for w in words if (t := w.strip(TRIM))), "") for words in (left, right))
    a, b = a[-MAX_CONTEXT:], b[:MAX_CONTEXT]
    a = ANY if MARK.search(a) or not a and start > REACH else a or EDGE
    b = ANY if MARK.search(b) or not b and len(text) > end + REACH else b or EDGE
    return f"{a} _ {b}"


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """``(pattern, string, place of kind or -1, start, end)``: seeds, and identifier-like strings outside them."""
    found = []
    for kind, start, end in base:
        found.append((context(text, start, end), text[start:end].lower(), kind, start, end))
    if MARK.search(text) is None:
        return found
    taken = sorted((s, e) for _, s, e in base)
    place, done = 0, 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, m.start()).end()
        done = end
        while start < end and text[start] in TRIM:
            start += 1
        while end > start and text[end - 1] in TRIM:
            end -= 1
        own = text[start:end]
        if len(own) < MIN_TOKEN or sum(c.isdigit() for c in own) < MIN_DIGITS:
            continue
        while place < len(taken) and taken[place][1] <= start:
            place += 1
        if any(s < end and start < e for s, e in taken[max(0, place - 4) : place + 4]):
            continue
        found.append((context(text, start, end), own.lower(), -1, start, end))
    return found


INSTANCE = pa.list_(
    pa.struct([("pattern", pa.string()), ("string", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
)
BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _extract(batches: Batches) -> Batches:
    for batch in batches:
        prints, bases, all_found = [], [], []
        for raw in batch.column(batch.num_columns - 1).to_pylist():
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            prints.append(xxh3_64_intdigest(raw) >> 1)
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            all_found.append(
                [dict(zip(("pattern", "string", "kind", "start", "end"), x, strict=True)) for x in instances(text, base)]
            )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(prints, pa.int64()), pa.array(bases, BASE), pa.array(all_found, INSTANCE)],
            [*batch.schema.names[:-1], "__print", "__base", "__found"],
        )


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_belief: float = MIN_BELIEF) -> DataFrame:
    """``pattern, kind, confidence, n_sure`` after scoring to the end.

    ``edges``: distinct ``pattern, string, kind`` with kind -1 for what no fixed form matches. Sure
    instances start at 1 for their kind, all others at 0. After ``rounds`` the instances believed at
    least as far as ``min_belief`` keep their belief and support patterns from then on; scoring starts
    again with them until no instance, and so no pattern, is added. Every start adds an instance, so
    it ends.
    """
    pairs = stage(edges.groupBy("pattern", "string").agg(F.max("kind").alias("kind")))
    sizes = stage(pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    unsure = pairs.where("kind < 0").drop("kind")
    sure = pairs.where("kind >= 0").select("pattern", "string", "kind", F.lit(1.0).alias("belief"))
    believed = stage(unsure.select("string", F.lit(0).alias("kind"), F.lit(0.0).alias("belief")).limit(0))
    while True:
        learned = believed
        for _ in range(rounds):
            spread = unsure.join(learned, "string").select("pattern", "string", "kind", "belief")
            patterns = stage(
                sure.unionByName(spread)
                .groupBy("pattern", "kind")
                .agg(F.sum("belief").alias("mass"), F.sum(F.when(F.col("belief") >= min_belief, 1).otherwise(0)).alias("n_sure"))
                .where(F.col("n_sure") >= MIN_SEEDS)
                .join(sizes, "pattern")
                .select("pattern", "kind", (F.col("mass") / (F.col("n") + SMOOTH)).alias("confidence"), "n_sure")
            )
            # An unsure instance is believed as far as its patterns leave no doubt, and never less than before.
            told = (
                unsure.join(patterns, "pattern")
                .groupBy("string", "kind")
                .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"))
            )
            learned = told.unionByName(believed).groupBy("string", "kind").agg(F.max("belief").alias("belief"))
        added = told.where(F.col("belief") >= min_belief).join(believed, ["string", "kind"], "left_anti")
        grown = stage(believed.unionByName(added))
        if grown.count() == believed.count():
            return patterns
        believed = grown


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The columns of ``docs`` but its text, with ``spans array<struct<kind, start, end>>``.

    Kinds ``email``, ``ip``, ``card`` and ``phone`` are fixed forms, by leftmost non-overlapping
    matches; ``context`` are strings with digits between words that surround at least ``MIN_SEEDS``
    different fixed-form or learned strings with at least ``min_confidence``. Offsets are code points, ends
    exclusive; spans are in order of kind and then start.

    Null and empty texts have none. Repeated rows count once for a pattern and get equal spans;
    rows without an id teach patterns and get their fixed forms only. An input column named
    ``spans`` is replaced.
    """
    lost = ("spans", text_col)
    rows = docs.select(packed(docs, *lost).alias("given"), quoted(id_col).alias("__owner"), as_bytes(quoted(text_col)).alias("__body"))
    found = stage(
        rows.mapInArrow(
            _extract,
            with_fields(
                rows,
                "__print long, __base array<struct<kind:int,start:long,end:long>>, "
                "__found array<struct<pattern:string,string:string,kind:int,start:long,end:long>>",
            ),
        )
    )
    each = found.select("__owner", F.col("__print").alias("__text"), F.explode("__found").alias("x")).select("__owner", "__text", "x.*")
    good = score_patterns(each.select("pattern", "string", "kind").distinct()).where(F.col("confidence") >= min_confidence)
    more = (
        each.where("kind < 0 and __owner is not null")
        .drop("kind")
        .join(good.select("pattern").distinct(), "pattern")
        .groupBy(F.col("__owner").alias("__of"), "__text")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__more"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("__base", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    learned = F.transform(
        F.coalesce("__more", F.array().cast("array<struct<start:long,end:long>>")),
        lambda s: F.struct(F.lit("context").alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    both = found.join(more, (F.col("__owner") == F.col("__of")) & (F.col("__print") == F.col("__text")), "left")
    return both.select(*unpacked(docs, F.col("given"), *lost), F.concat(base, learned).alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed forms, SHA-256 of their spans, and all spans as text."""
    fixed = F.filter("spans", lambda s: s["kind"] != "context")
    counts = [count_of("spans", k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        quoted(id_col), *counts, F.sha2(joined(fixed), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
