"""How the sources of a language differ: smoothed shares of words, compared in whole numbers.

Tasks count words per (language, source) before anything is shuffled. From then on only kept words
go on: those in enough documents of their language.

* Pairs of sources: the distance is a sum over all kept words, most of which a source does not hold.
  Such a word has the source's least share. So the sum over all words is taken as if nobody
  held any, and corrected once for each source's own words (by a histogram of its shares) and once
  for each word that both hold.
* Leading words of a source: a word's excess over its language grows with its count in the source,
  falls with its count in the language, and ties go to the earlier word. A word that ``top`` others
  dominate in these three cannot be among the leading ``top``. Every partition keeps its skyband, the
  words that fewer than ``top`` others dominate; skybands are merged, and the rest is ranked exactly.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwave.llm.storage import Batches, as_bytes, discard, quoted, stage

MIN_DOCS = 30  # of a language that must hold a word
PRIOR = 5  # added to every count
UNIT = 1_000_000_000
TOP = 50
HELD = 400_000  # words a task counts before it hands them on
BAND_ROWS = 200_000  # words of which a task takes the skybands at once
SALTS = 32  # parts of a group that are merged or compared by themselves
MAX_SENT = 100_000  # groups that may be sent to all tasks; more are joined

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def _rows(counted: dict, held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), n in counted.items():
        terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
        whole = pa.concat_arrays([pa.nulls(1, pa.string()), terms])  # the null term stands for the group itself
        docs = held[lang, source]
        columns = [pa.array([name] * len(whole), pa.string()) for name in (lang, source)]
        columns += [whole, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)


def _count(batches: Batches) -> Batches:
    counted, held, size = defaultdict(Counter), defaultdict(Counter), 0
    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = words(text)
            n = counted[lang, source]
            size -= len(n)
            n.update(found)
            size += len(n)
            held[lang, source].update(set(found))
        if size >= HELD:
            yield from _rows(counted, held)
            counted, held, size = defaultdict(Counter), defaultdict(Counter), 0
    yield from _rows(counted, held)


def skyband(here: np.ndarray, there: np.ndarray, place: np.ndarray, top: int) -> np.ndarray:
    """Positions of the rows that fewer than ``top`` others dominate.

    A row dominates another with no smaller ``here``, no larger ``there`` and an earlier ``place``
    (all different). Rows come in an order in which no row dominates an earlier one; a binary indexed
    tree over the values of ``there`` holds the earliest ``top`` places of kept rows in each node.
    Dropped rows need not be held: the kept ones that dominate them dominate all they would.
    """
    order = np.lexsort((place, there, -here))
    level = np.unique(there, return_inverse=True)[1] + 1
    size = int(level.max(initial=0))
    nodes: list[list[int]] = [[] for _ in range(size + 1)]
    kept = []
    for row, at, where in zip(order.tolist(), level[order].tolist(), place[order].tolist(), strict=True):
        above, i = 0, at
        while i and above < top:
            above += bisect_left(nodes[i], where)
            i &= i - 1
        if above >= top:
            continue
        kept.append(row)
        while at <= size:
            node = nodes[at]
            if len(node) < top or where < node[-1]:
                insort(node, where)
                if len(node) > top:
                    node.pop()
            at += at & -at
    return np.array(kept, np.int64)


def _places(terms: pa.Array) -> np.ndarray:
    """The rank of each term in the order of its bytes."""
    order = pc.sort_indices(terms.cast(pa.binary())).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _thin(batch: pa.Table, top: int) -> pa.Table:
    """The skyband of every group in the table."""
    batch = batch.combine_chunks()
    group = batch["gid"].to_numpy()
    here, there = batch["n"].to_numpy(), batch["total"].to_numpy()
    place = _places(batch["term"].combine_chunks())
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    kept = [rows[skyband(here[rows], there[rows], place[rows], top)] for rows in np.split(order, cuts) if len(rows)]
    return batch.take(pa.array(np.concatenate(kept) if kept else [], pa.int64()))


def _bands(batches: Batches, top: int) -> Batches:
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= BAND_ROWS:
            yield from _thin(pa.Table.from_batches(waiting), top).to_batches()
            waiting, rows = [], 0
    if rows:
        yield from _thin(pa.Table.from_batches(waiting), top).to_batches()


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept))`` in whole numbers; null if nothing is kept."""
    below = total + PRIOR * kept
    above = (n + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, F.when(below > 0, below).cast("decimal(20,0)")))


def sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_SENT else df


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``of, other, value``: the sum of the gaps over all kept words, for both orders of every pair."""
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    own = cells.groupBy("lang", "gid", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    lone = groups.select("lang", "gid", "p0", F.lit(None).cast("long").alias("p"), F.col("kept").alias("m"))
    # A language may hold most groups: its rows are dealt to salts, and the other side is in every salt.
    rows = own.union(lone).withColumn("salt", F.pmod(F.xxhash64("gid", "p"), F.lit(SALTS)))
    others = groups.select(
        "lang", F.col("gid").alias("other"), F.col("p0").alias("other_p0"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
    )
    met = rows.join(others, ["lang", "salt"]).where("gid <> other")
    none = F.coalesce(gap("p0", "other_p0"), F.lit(0))
    singles = met.groupBy("gid", "other").agg(
        F.sum(F.when(F.col("p").isNull(), F.col("m") * none).otherwise(0)).alias("base"),
        F.sum(F.when(F.col("p").isNotNull(), F.col("m") * (gap("p", "other_p0") - none)).otherwise(0)).alias("single"),
    )
    right = cells.select("lang", "term", F.col("gid").alias("other"), F.col("p").alias("other_p"), F.col("p0").alias("other_p0"))
    both = (
        cells.select("lang", "term", "gid", "p", "p0")
        .join(right, ["lang", "term"])
        .where("gid < other")
        .groupBy("gid", "other")
        .agg(F.sum(gap("p", "other_p") - gap("p", "other_p0") - gap("p0", "other_p") + gap("p0", "other_p0")).alias("shared"))
    )
    parts = singles.select("gid", "other", (F.col("base") + F.col("single")).alias("value"))
    parts = parts.union(singles.select("other", "gid", "single"))
    parts = parts.union(both.select("gid", "other", "shared")).union(both.select("other", "gid", "shared"))
    return parts.groupBy("gid", "other").agg(F.sum("value").alias("value"))


def _leaders(cells: DataFrame, top: int) -> DataFrame:
    """``gid, term, value, rank``: the words with the largest excess over the language."""
    over = cells.where("p > q").select("gid", "term", "n", "total", (F.col("p") - F.col("q")).alias("value"))
    fields = over.schema
    # A hot source is merged in parts; the ranking takes the leaders of each part before it shuffles.
    bands = over.mapInArrow(partial(_bands, top=top), fields).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    merged = bands.repartition("gid", "salt").drop("salt").mapInArrow(partial(_bands, top=top), fields)
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "term")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) that occurs.

    Words are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the
    words that at least ``min_docs`` of its rows hold; each has in every source of the language the
    share ``1 + floor(UNIT * (n + PRIOR) / (N + PRIOR * V))``, with its count n there, the sum N of the
    counts of all kept words there, and their number V; likewise in the language.

    Part ``pair``: every other source of the language by the sum of the absolute differences of the
    shares over all kept words (0 if there are none). Part ``term``: up to ``top`` kept words that the
    source holds with a larger share than the language's, by the difference. Ranks start at 1, larger
    values first, ties in the order of UTF-8 bytes.

    Null texts, languages and sources count as empty strings; an empty string is a language or source
    of its own. Every row is a document, so repeated rows count again. A source without words has its
    pairs; the only source of a language has none. An empty table gives no rows. Other columns are
    not read.
    """
    named = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    given = docs.select(as_bytes(quoted(text_col)).alias("b"), named(lang_col).alias("l"), named(source_col).alias("s"))
    counts = given.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = stage(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = stage(
        counted.where("term is not null")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )
    kept = stage(counted.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = (
        counted.where("term is null")
        .select("lang", "source")
        .join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", zero("group_n"), zero("lang_n"), F.coalesce("v", F.lit(0)).alias("kept"))
    )
    groups = stage(
        groups.withColumn("p0", share(F.lit(0), F.col("group_n"), F.col("kept"))).withColumn("gid", F.monotonically_increasing_id())
    )
    discard(counted, terms)
    cells = kept.join(sent(groups), ["lang", "source"]).select(
        "lang", "gid", "term", "n", "total", "p0",
        share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"),
        share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"),
    )
    names = groups.select("gid", "lang", "source")
    others = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    pairs = _pairs(cells, groups).join(others, "other").withColumn("rank", F.row_number().over(order))
    leaders = _leaders(cells, top).withColumnRenamed("term", "item")
    pick = lambda df, part: df.select("gid", F.lit(part).alias("part"), "item", "value", "rank")
    done = pick(pairs, "pair").union(pick(leaders, "term"))
    return done.join(sent(names), "gid").select("lang", "source", "part", "item", "value", "rank")
