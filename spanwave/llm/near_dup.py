"""Near-duplicate documents by MinHash signatures joined on their coordinates.

1. Texts with equal shingle sets form a class; only classes go on.
2. A class is posted under each of its (coordinate, value) pairs that another class may share (a Bloom
   pair tells), rarest first, up to the prefix: two signatures that agree in at least ``MATCHES``
   of ``COORDINATES`` places share one of their ``COORDINATES - MATCHES + 1`` rarest pairs. Common
   values fall outside the prefix, so their long posting lists are skipped.
3. In each posting list every class meets the most central one; signatures that agree often
   enough are confirmed on the full sets. That makes a group of near copies one component without
   its pairs being listed.
4. Where classes of one list are still in different components, they are compared with each other,
   inside tasks and in blocks, and again confirmed on the full sets. Only joining links come out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from spanwave.llm import bloom
from spanwave.llm.components import components
from spanwave.llm.storage import Batches, as_bytes, distinct, list_of, numbers, quoted, stage

WORDS = 5
PERCENT = 75  # of the union that the intersection must have
COORDINATES = 64
MATCHES = 30  # at similarity 0.75 fewer come about once in some million pairs
PREFIX = COORDINATES - MATCHES + 1
BLOCK = 4096  # classes compared with each other in one task
MAX_SENT = 1_000_000  # ids that may be sent to all tasks; more are joined
MEMO_WORDS = 150_000

_random = np.random.RandomState(20240229)
FLIP = _random.randint(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64)[:, None]
SPREAD = (_random.randint(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
PLACES = _random.randint(0, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of all words together if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashed[i : i + n] * PLACES[i]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    return distinct(total)


def signature(codes: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest hash in each coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(codes), 8192):
        np.minimum(least, ((codes[start : start + 8192] ^ FLIP) * SPREAD).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign(batches: Batches) -> Batches:
    memo = WordHashes()
    for batch in batches:
        sizes, keys, signs = [], [], []
        for text in batch.column(1).to_pylist():
            codes = shingles(text, memo)
            sizes.append(len(codes))
            keys.append(xxh3_128_digest(codes.tobytes()))
            signs.append(signature(codes).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
            ["owner", "n", "class", "sign"],
        )


def coordinate_keys(signs: list[bytes]) -> np.ndarray:
    """One row of 64-bit keys per signature: the coordinate and its value, mixed."""
    values = np.frombuffer(b"".join(signs), np.uint32).reshape(len(signs), COORDINATES).astype(np.uint64)
    keys = values | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))
    keys *= np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(31))


def short(signs: list[bytes]) -> list[bytes]:
    """One byte of each coordinate: agreement on it never understates the agreement of signatures."""
    values = np.frombuffer(b"".join(signs), np.uint32).reshape(len(signs), COORDINATES)
    return [row.tobytes() for row in (values >> np.uint32(3)).astype(np.uint8)]


def _fill(batches: Batches, bits: int) -> Batches:
    hashed = (coordinate_keys(b.column(0).to_pylist()).reshape(-1) for b in batches if b.num_rows)
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    for rows in bloom.fill(hashed, bits):
        yield pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)


def _post(batches: Batches, filled) -> Batches:
    """Postings ``class, key`` of the coordinates that may be shared."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = coordinate_keys(batch.column(1).to_pylist()).reshape(-1)
        at = np.flatnonzero(bloom.may_repeat(keys, filled.value))
        names = batch.column(0).take(pa.array(at // COORDINATES))
        yield pa.RecordBatch.from_arrays([names, pa.array(keys[at].view(np.int64))], ["class", "key"])


def _shorten(batches: Batches) -> Batches:
    for batch in batches:
        signs = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short(signs) if signs else [], pa.binary())], ["class", "short"])


@F.pandas_udf(T.IntegerType())
def _agree(left: pd.Series, right: pd.Series) -> pd.Series:
    """In how many places two short signatures agree."""
    if not len(left):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), COORDINATES) for s in (left, right))
    return pd.Series((a == b).sum(axis=1).astype(np.int32))


def enough(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    return 100 * common >= PERCENT * (a + b - common)


@F.pandas_udf(T.BooleanType())
def _linked(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two full sets, as sorted 64-bit hashes, are similar enough."""
    found = []
    for a, b in zip(left, right, strict=True):
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        found.append(bool(enough(int(np.count_nonzero(b[at] == a)), len(a), len(b))))
    return pd.Series(found)


def _sets(batches: Batches) -> Batches:
    memo = WordHashes()
    for batch in batches:
        codes = [shingles(text, memo).tobytes() for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxh3_128_digest(c) for c in codes], pa.binary()), pa.array(codes, pa.binary())], ["class", "codes"]
        )


def _full_sets(source: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, codes`` of the wanted classes, from the texts of their first documents."""
    owners = stage(classes.join(wanted, "class").select("rep").distinct())
    if owners.count() <= MAX_SENT:
        owners = F.broadcast(owners)
    texts = source.join(owners, source["owner"] == owners["rep"], "left_semi").select("body")
    sets = texts.mapInArrow(_sets, "class binary, codes binary")
    return stage(sets.join(wanted, "class", "left_semi").dropDuplicates(["class"]))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("codes").alias("a_codes"))
    right = sets.select(F.col("class").alias("b"), F.col("codes").alias("b_codes"))
    return pairs.join(left, "a").join(right, "b").where(_linked("a_codes", "b_codes")).select("a", "b")


def _involved(part: pd.DataFrame) -> pd.DataFrame:
    """Members of a block pair whose signature agrees often enough with one of another component."""
    signs = np.frombuffer(b"".join(part["short"]), np.uint8).reshape(len(part), COORDINATES)
    label = part["component"].factorize()[0]
    size = part["n"].to_numpy()
    hit = np.zeros(len(part), bool)
    for start in range(0, len(part), 64):
        rows = slice(start, start + 64)
        other = label[rows, None] != label[None, :]
        other &= 100 * np.minimum(size[rows, None], size[None, :]) >= PERCENT * np.maximum(size[rows, None], size[None, :])
        if other.any():
            same = (signs[rows, None, :] == signs[None, :, :]).sum(axis=2, dtype=np.int16) >= MATCHES
            same &= other
            hit[rows] |= same.any(axis=1)
    return part.loc[hit, ["center", "class", "i", "j", "component"]]


def _join_components(part: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of a block pair, by their full sets, as few as join them."""
    sets = [np.frombuffer(c, np.uint64) for c in part["codes"]]
    label = part["component"].factorize()[0].astype(np.int64)
    parent = np.arange(label.max() + 1)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(codes.max() + 1, bool)
    biggest = np.bincount(label).argmax()
    names, found = part["class"].tolist(), []
    for i in np.flatnonzero(label != biggest):
        own = codes[edges[i] : edges[i + 1]]
        marked[own] = True
        common = np.add.reduceat(marked[codes], edges[:-1], dtype=np.int64)
        marked[own] = False
        for k in np.flatnonzero(enough(common, sizes[i], sizes)):
            a, b = root(label[i]), root(label[k])
            if a != b:
                parent[a] = b
                found.append((names[i], names[k]))
    return pd.DataFrame(found, columns=["a", "b"])


def _blocks(groups: DataFrame) -> DataFrame:
    """Groups with their rows dealt to pairs of blocks ``i <= j``: one pair unless the group is large."""
    sizes = groups.groupBy("center").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    # Every member has met the center; what is left needs two members in different components.
    sizes = stage(sizes.where("low <> high").select("center", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")))
    rows = groups.join(sizes, "center").withColumn("own", F.pmod(F.hash("class"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "parts")


def _links(source: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the first documents of classes: enough of them for the components."""
    spark = source.sparkSession
    bits = bloom.bits_for(classes.count() * COORDINATES, 8)
    pairs = classes.select("sign").mapInArrow(partial(_fill, bits=bits), bloom.SCHEMA)
    filled = bloom.twice_filter(pairs, bits, spark)
    posted = stage(classes.select("class", "sign").mapInArrow(partial(_post, filled=filled), "class binary, key long"))
    counts = stage(posted.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    # By class: its shared pairs, rarest first. The pairs that it shares with nobody come before them.
    ranked = posted.join(counts, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("pairs"))
    take = F.lit(PREFIX - COORDINATES) + F.size("pairs")
    shorts = classes.select("class", "sign").mapInArrow(_shorten, "class binary, short binary")
    central = F.aggregate("pairs", F.lit(0).cast("long"), lambda a, p: a + p["held"])
    posts = stage(
        ranked.where(take > 0)
        .select("class", central.alias("central"), F.explode(F.slice("pairs", F.lit(1), take)).alias("p"))
        .join(shorts, "class")
        .select("class", "central", "short", F.col("p.key").alias("key"))
    )
    centers = stage(
        posts.groupBy("key")
        .agg(F.max(F.struct("central", "class", "short")).alias("c"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", F.col("c.class").alias("center"), F.col("c.short").alias("center_short"))
    )
    met = stage(
        posts.join(centers, "key")
        .where(F.col("class") != F.col("center"))
        .select("center", "class", "short", _agree("short", "center_short").alias("agree"))
        .distinct()
    )
    close = stage(met.where(F.col("agree") >= MATCHES).select(F.col("center").alias("a"), F.col("class").alias("b")))
    wanted = close.select(F.col("a").alias("class")).union(close.select("b")).distinct()
    first = stage(_confirm(close, _full_sets(source, classes, wanted)))
    labels = components(first)
    sizes = classes.select("class", "n")
    groups = met.join(labels, met["class"] == labels["node"], "left").select(
        "center", "class", "short", F.coalesce("component", "class").alias("component")
    )
    involved = stage(
        _blocks(groups)
        .join(sizes, "class")
        .groupBy("center", "i", "j")
        .applyInPandas(_involved, "center binary, class binary, i int, j int, component binary")
    )
    more = _full_sets(source, classes, involved.select("class").distinct())
    second = (
        involved.join(more, "class").groupBy("center", "i", "j").applyInPandas(_join_components, "a binary, b binary")
    )
    links = first.union(second)
    reps = classes.select("class", "rep")
    return (
        links.join(reps.withColumnsRenamed({"class": "a", "rep": "a_rep"}), "a")
        .join(reps.withColumnsRenamed({"class": "b", "rep": "b_rep"}), "b")
        .select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Shingles are runs of five words of the text with A-Z lower-cased; fewer words are one shingle.
    Documents are linked if the intersection of their sets has at least three quarters of the
    union; ``component_id`` is the smallest id reachable over links, ``kept`` marks that document.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share an id
    are one document, linked by any of their texts. Rows without an id are linked with nothing,
    have no component and are kept. Other columns are not read.
    """
    source = docs.select(quoted(id_col).alias("owner"), as_bytes(quoted(text_col)).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stage(source.mapInArrow(_sign, f"owner {kind}, n long, class binary, sign binary"))
    real = signed.where("n > 0 and owner is not null")
    classes = stage(
        real.groupBy("class")
        .agg(F.min(F.struct("owner", "n", "sign")).alias("first"))
        .select("class", F.col("first.owner").alias("rep"), F.col("first.n").alias("n"), F.col("first.sign").alias("sign"))
    )
    names = signed.select("owner", "n", "class").join(classes.select("class", "rep"), "class", "left")
    # An id on rows with different sets links their classes.
    several = real.groupBy("owner").agg(F.count_distinct("class").alias("k")).where("k > 1")
    same_id = names.where("n > 0").join(several, "owner").select(F.col("owner").alias("a"), F.col("rep").alias("b"))
    linked = components(_links(source, classes).union(same_id.where("a <> b")))
    reach = names.join(linked, names["rep"] == linked["node"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("owner"))
    done = reach.select("owner", "n", F.when(F.col("owner").isNotNull(), component).alias("component"))
    return done.select(
        F.col("owner").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("owner") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id."""
    gone = stage(near_duplicates(docs, id_col, text_col).where("not kept").select(quoted(id_col).alias("__gone")).distinct())
    if gone.count() <= MAX_SENT:
        gone = F.broadcast(gone)
    return docs.join(gone, quoted(id_col) == F.col("__gone"), "left_anti")
