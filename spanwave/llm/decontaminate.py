"""Benchmark items in documents, up to an edit budget: exact pieces, then bit-parallel distances.

An item with budget e is cut into e + 1 pieces. Whatever differs from it by at most e edits holds at
least one piece unchanged, so every piece is searched (one automaton a block of items) and only the
surroundings of hits are compared with the item.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.llm.storage import Batches, as_bytes, quoted, stage

EDIT_SHARE = 0.05  # edits allowed for each code point of an item
BLOCK_BYTES = 1 << 20  # text of the items searched in one pass over the documents; their automaton takes some 28 times that


def normal(text: str) -> str:
    """Lower case, words joined by single spaces."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` parts of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``item`` to a substring of ``text`` and the first end of such a one.

    None if it is above ``budget``. Bit-parallel (Myers): one column of the table, as vertical
    differences, in two integers of as many bits as the item has code points.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, where = budget + 1, -1
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if distance < best:
            best, where = distance, j + 1
            if not best:
                break
    return None if best > budget else (best, where)


class Items:
    """A block of benchmark items with the automaton of all their pieces."""

    def __init__(self, rows: list[tuple], share: float) -> None:
        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for name, text in rows:
            text = normal(text or "")
            if not text:
                continue
            budget = int(len(text) * share)
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((name, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, of in places.items():
            self.automaton.add_word(piece, (len(piece), tuple(of)))
        if places:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple]:
        """``(item, distance, end)`` of every item within its budget; offsets in the normalised text."""
        if not self.items:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                _, item, budget = self.items[i]
                start = max(0, last + 1 - length - offset - budget)
                stop = min(len(text), last + 1 - length - offset + len(item) + budget)
                own = spans.setdefault(i, [])
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], stop)
                    own[-1][0] = min(own[-1][0], start)
                else:
                    own.append([start, stop])
        found = []
        for i, own in spans.items():
            name, item, budget = self.items[i]
            hits = [(d, start + end) for start, stop in own if (hit := best_match(item, text[start:stop], budget)) for d, end in [hit]]
            if hits:
                found.append((name, *min(hits)))
        return found


class Search:
    """The task side."""

    def __init__(self, items) -> None:
        self.items = items

    def __call__(self, batches: Batches) -> Batches:
        items = self.items.value
        for batch in batches:
            owners, names, distances, ends = [], [], [], []
            for owner, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, distance, end in items.search(normal(raw.decode("utf-8", "replace"))):
                    owners.append(owner)
                    names.append(name)
                    distances.append(distance)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owners, batch.column(0).type),
                    pa.array(names, pa.string()),
                    pa.array(distances, pa.int32()),
                    pa.array(ends, pa.int64()),
                ],
                ["owner", "item", "distance", "end"],
            )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edit_share: float = EDIT_SHARE,
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, distance, end_at``.

    Both texts are compared in lower case with white space folded; an item is held if some part of
    the document is within ``edit_share`` edits for each of its code points (rounded down).
    ``distance`` is the smallest, ``end_at`` the first place in the normalised text where a part
    with it ends.

    The benchmark is a query set: it is collected in blocks of about ``BLOCK_BYTES``, one after another, each
    searched in all documents and its hits written before the next is read. Empty and null items match nothing; null documents hold nothing. Repeated
    documents or items give one row. Other columns are not read.
    """
    if not 0 <= edit_share < 1:
        raise ValueError("the share of edits must be at least 0 and below 1")
    spark = docs.sparkSession
    items = benchmark.select(quoted(item_col).alias("item"), quoted(item_text_col).cast("string").alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, id_col), (benchmark, item_col)))
    source = docs.select(quoted(id_col).alias("owner"), as_bytes(quoted(text_col)).alias("body"))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).select(F.col("item").cast("string"), "body")
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in block.collect()], edit_share))
        rows = source.mapInArrow(Search(shared), f"owner {kind}, item string, distance int, end long")
        hits = stage(rows)
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return (
        found.groupBy("owner", "item")
        .agg(F.min(F.struct("distance", "end")).alias("best"))
        .select(
            F.col("owner").alias(id_col),
            F.col("item").cast(item_kind).alias(item_col),
            F.col("best.distance").alias("distance"),
            F.col("best.end").alias("end_at"),
        )
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows without an id stay."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options).select(quoted(id_col).alias("__leak")).distinct()
    return docs.join(leaks, quoted(id_col) == F.col("__leak"), "left_anti")
