"""Exact Jaccard join of shingle sets by partitions of the universe.

1. Texts with equal shingle sets form a class. Classes fall into size bands so narrow that a linked
   pair lies in one band or in two adjacent ones. A band cuts the universe of 64-bit hashes into ranges,
   its segments, one more than the hashes in which a linked pair of the band can differ: so some segment is equal.
2. A class is posted under its segments of its own band, where others look it up, and looks up itself
   there and in the band below. Counts of all postings tell what a look-up costs. Each class then
   allocates its budget: a segment left out counts 0, one looked up as it is counts 1, one looked up
   with one deletion on either side counts 2, and the counts must exceed the possible differences.
   Costly segments are left out, for cheap ones with their one-deletion neighbourhoods.
3. Every class of a posting list meets its central class; parity sketches bound the difference from
   below, and what they leave is verified on full sets. That makes most groups of copies one
   component without their pairs being listed.
4. Lists that still span components are compared inside tasks, in blocks bounded by rows and bytes; again
   sketches first, then full sets. Only joining links come out.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from spanwave.llm.components import components
from spanwave.llm.storage import Batches, as_bytes, discard, distinct, quoted, stage

WORDS = 3
PERCENT = 90  # of the union that the intersection must have
SWAP = 8  # postings that a look-up with one deletion must spare for each posting it adds
BLOCK_ROWS = 1024
BLOCK_BYTES = 16 << 20
MAX_SENT = 1_000_000  # rows that may be sent to all tasks; more are joined
MAX_ENTRIES = 8_000_000  # entries of arrays likewise
MEMO_WORDS = 150_000
NEVER = 1 << 40  # a cost beyond all others

_random = np.random.RandomState(20250713)
PLACES = _random.randint(0, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
DELETED = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingles(text: bytes, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of three words; of all words together if there are fewer."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(WORDS, len(found))
    n = len(found) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashed[i : i + n] * PLACES[i]
    return distinct(mixed(total))


def differences(sizes: int | np.ndarray) -> int | np.ndarray:
    """In how many members two linked sets may differ, by the sum of their sizes."""
    return sizes * (100 - PERCENT) // (100 + PERCENT)


@lru_cache(maxsize=100_000)
def band_of(size: int) -> tuple[int, int, int]:
    """Number of the band of a size, its first size and the first one beyond it."""
    number, low, high = 0, 1, 2
    while size >= high:
        number, low, high = number + 1, high, high * 100 // PERCENT + 1
    return number, low, high


@lru_cache(maxsize=100_000)
def segments_of(high: int) -> int:
    """Segments of the band that ends before ``high``: one more than a pair can differ that has its smaller set there."""
    return differences(high - 1 + (high - 1) * 100 // PERCENT) + 1


class Cut:
    """A set cut by the segments of one band: the key of each segment, and of each segment less one member."""

    def __init__(self, codes: np.ndarray, number: int, high: int):
        self.parts = segments_of(high)
        self.at = (((codes >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int64)
        self.sizes = np.bincount(self.at, minlength=self.parts)
        self.own = mixed(codes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.own, dtype=np.uint64)])
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sums = sums[edges[1:]] - sums[edges[:-1]]
        self.salt = np.arange(1, self.parts + 1, dtype=np.uint64) * ODD + np.uint64(number)
        self.keys = mixed(mixed(self.sums) ^ self.salt)

    def less_one(self, chosen: np.ndarray) -> np.ndarray:
        """Keys of the chosen segments less each of their members in turn."""
        inside = chosen[self.at]
        at = self.at[inside]
        return mixed(mixed(self.sums[at] - self.own[inside]) ^ self.salt[at])


def cuts(codes: np.ndarray) -> list[tuple[Cut, int]]:
    """The cuts of a set by its own band and by the one below, with the most members a pair found there may differ in."""
    n = len(codes)
    number, low, high = band_of(n)
    done = [(Cut(codes, number, high), int(differences(n + min(high - 1, n * 100 // PERCENT))))]
    if number and (low - 1) * 100 >= n * PERCENT:
        done.append((Cut(codes, number - 1, low), int(differences(n + low - 1))))
    return done


def allocate(costs: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """0, 1 or 2 by segment, with a sum of at least ``least`` at little cost.

    ``costs`` are the postings a look-up finds. All segments start at 1; the costliest beyond ``least``
    are left out. Then a costly segment is left out for a cheap one with deletions, as long as that spares
    ``SWAP`` times the postings it adds.
    """
    order = np.argsort(-costs, kind="stable")
    given = np.ones(len(costs), np.int64)
    spare = max(0, len(costs) - least)
    given[order[:spare]] = 0
    rest = order[spare:]
    cheap = rest[np.argsort((costs + sizes)[rest], kind="stable")]
    dear, i = rest.tolist(), 0
    for j in cheap.tolist():
        if i >= len(dear) or given[dear[i]] != 1 or dear[i] == j or given[j] != 1:
            break
        if costs[dear[i]] <= SWAP * (costs[j] + sizes[j] + 2):
            break
        given[dear[i]], given[j] = 0, 2
        i += 1
    return given


def _sign(batches: Batches) -> Batches:
    memo = WordHashes()
    for batch in batches:
        codes = [shingles(text, memo) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(c) for c in codes], pa.int64()),
                pa.array([xxh3_128_digest(c.tobytes()) for c in codes], pa.binary()),
                pa.array([c.tobytes() for c in codes], pa.binary()),
            ],
            ["owner", "n", "class", "codes"],
        )


def _sets(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    """Numbers and sets of a batch ``cid, codes, ...``."""
    return [(c, np.frombuffer(b, np.uint64)) for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]


def _keyed(parts: list[tuple], flags: list[str]) -> pa.RecordBatch:
    """Rows ``key, cid`` and boolean flags from (keys, cid, flag values)."""
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    sizes = [len(p[0]) for p in parts]
    columns = [pa.array(keys.view(np.int64)), pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), sizes))]
    columns += [pa.array(np.repeat(np.array([p[2 + i] for p in parts], bool), sizes)) for i in range(len(flags))]
    return pa.RecordBatch.from_arrays(columns, ["key", "cid", *flags])


def _post(batches: Batches) -> Batches:
    """Postings ``key, cid, held``: held ones can be found, the others only look up."""
    for batch in batches:
        parts = [(cut.keys, cid, i == 0) for cid, codes in _sets(batch) for i, (cut, _) in enumerate(cuts(codes))]
        yield _keyed(parts, ["held"])


def _allocate(batches: Batches) -> Batches:
    """Look-ups and postings ``key, cid, looks, kind`` of each class, given its shared keys and their counts.

    Kinds: 0 a segment that both sides have as it is, 1 one to be found among the segments of others,
    2 one to be found among the others' segments less one member.
    """
    names = ["looks", "one", "two"]
    for batch in batches:
        parts = []
        for (cid, codes), keys, counts in zip(_sets(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            known = dict(zip(keys, counts, strict=True))
            for i, (cut, limit) in enumerate(cuts(codes)):
                found = np.array([known.get(k, 0) for k in cut.keys.view(np.int64).tolist()], np.int64)
                given = allocate(found, cut.sizes, limit + 1)
                parts.append((cut.keys[(given > 0) & (found > 0)], cid, True, False, False))
                if i == 0:
                    parts.append((cut.keys[found > 0], cid, False, False, False))
                if (given == 2).any():
                    parts.append((cut.less_one(given == 2), cid, True, True, False))
                    parts.append((cut.keys[given == 2] ^ DELETED, cid, True, False, True))
        yield _keyed(parts, names)


def _neighbours(batches: Batches) -> Batches:
    """Every segment of the own band, and every segment less one member, as ``key, cid``."""
    for batch in batches:
        parts = []
        for cid, codes in _sets(batch):
            cut = cuts(codes)[0][0]
            parts += [(cut.keys, cid), (cut.less_one(np.ones(cut.parts, bool)) ^ DELETED, cid)]
        yield _keyed(parts, [])


def sketch(codes: np.ndarray) -> bytes:
    """Parities of the members dealt to a power of two of bits, at least twice as many as members.

    Each member in which two sets differ turns one bit, so no pair differs in fewer members than bits.
    """
    bits = 1 << max(6, (2 * len(codes) - 1).bit_length())
    odd = np.bincount((codes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    """A longer sketch as one of ``length`` bytes: members dealt to fewer bits."""
    while len(bits) > length:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _describe(batches: Batches) -> Batches:
    for batch in batches:
        sets = _sets(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(c) for _, c in sets], pa.int64()), pa.array([sketch(c) for _, c in sets], pa.binary())],
            ["cid", "n", "sketch"],
        )


def enough(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return enough(int(np.count_nonzero(b[at] == a)), len(a), len(b))


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, a_n: pd.Series, b: pd.Series, b_n: pd.Series) -> pd.Series:
    """Whether sizes and sketches let two sets be linked."""
    done = []
    for x, m, y, n in zip(a, a_n, b, b_n, strict=True):
        if 100 * min(m, n) < PERCENT * max(m, n):
            done.append(False)
            continue
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        length = min(len(x), len(y))
        gap = int(np.bitwise_count(folded(x, length) ^ folded(y, length)).sum())
        done.append(gap <= differences(m + n))
    return pd.Series(done, dtype=bool)


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _candidates(part: pd.DataFrame) -> np.ndarray:
    """Pairs of rows of a block pair in different components that sizes and sketches let be linked."""
    sizes = part["n"].to_numpy()
    label = part["component"].to_numpy()
    looks = part["looks"].to_numpy()
    raw = [np.frombuffer(s, np.uint8) for s in part["sketch"]]
    length = min(map(len, raw))
    signs = np.stack([folded(s, length) for s in raw]).view(np.uint64)
    found = []
    step, most = max(1, (1 << 22) // len(part)), max(1, (1 << 21) // signs.shape[1])
    for start in range(0, len(part), step):
        rows = slice(start, start + step)
        may = (label[rows, None] != label[None]) & (looks[rows, None] | looks[None])
        may &= 100 * np.minimum(sizes[rows, None], sizes[None]) >= PERCENT * np.maximum(sizes[rows, None], sizes[None])
        may &= np.arange(start, min(start + step, len(part)))[:, None] < np.arange(len(part))[None]
        left, right = np.nonzero(may)
        for cut in range(0, len(left), most):
            a, b = left[cut : cut + most] + start, right[cut : cut + most]
            gap = np.bitwise_count(signs[a] ^ signs[b]).sum(axis=1, dtype=np.int64)
            near = gap <= differences(sizes[a] + sizes[b])
            found.append(np.stack([a[near], b[near]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _involved(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block pair that have a candidate."""
    rows = np.unique(_candidates(part)) if len(part) > 1 else []
    return part.iloc[rows]


def _join_components(part: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of a block pair, verified on full sets, as few as join them."""
    label = part["component"].factorize()[0]
    parent = list(range(len(part)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [np.frombuffer(c, np.uint64) for c in part["codes"]]
    names, found = part["cid"].tolist(), []
    for i, j in _candidates(part).tolist():
        a, b = root(label[i]), root(label[j])
        if a != b and linked(sets[i], sets[j]):
            parent[a] = b
            found.append((names[i], names[j]))
    return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")


def sent(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """``df``, to be sent to all tasks if it is small; it must be staged.

    Small is at most ``MAX_SENT`` rows, of fixed width, or entries of the arrays in its rows; an entry takes
    16 bytes at most.
    """
    held = df.agg(F.coalesce(F.sum(F.lit(1) if entries is None else entries + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= (MAX_SENT if entries is None else MAX_ENTRIES) else df


def _lists(sets: DataFrame) -> DataFrame:
    """Posting lists ``key, cid, looks``: any linked pair of classes shares a key that one of the two looks up."""
    posted = sets.mapInArrow(_post, "key long, cid long, held boolean")
    shared = (
        posted.groupBy("key")
        .agg(F.count_if("held").alias("found"), F.count(F.lit(1)).alias("all"))
        .where("found > 0 and all > 1")
        .select("key", "found")
    )
    costs = posted.join(shared, "key").groupBy("cid").agg(F.collect_set(F.struct("key", "found")).alias("k"))
    costs = stage(costs.select("cid", F.col("k.key").alias("keys"), F.col("k.found").alias("counts")))
    given = sets.join(sent(costs, F.size("keys")), "cid").select("cid", "codes", "keys", "counts")
    fields = "key long, cid long, looks boolean, one boolean, two boolean"
    rows = stage(given.mapInArrow(_allocate, fields))
    lists = rows.select("key", "cid", "looks")
    asked = stage(rows.where("one or two").select("key").distinct())
    if not asked.isEmpty():
        near = sets.mapInArrow(_neighbours, "key long, cid long").join(sent(asked), "key", "left_semi")
        lists = lists.union(near.select("key", "cid", F.lit(False)))
    return lists.groupBy("key", "cid").agg(F.max("looks").alias("looks"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    wanted = stage(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    few = stage(sets.join(sent(wanted), "cid", "left_semi"))
    left, right = few.withColumnsRenamed({"cid": "a", "codes": "a_codes"}), few.withColumnsRenamed({"cid": "b", "codes": "b_codes"})
    return pairs.join(left, "a").join(right, "b").where(_linked("a_codes", "b_codes")).select("a", "b")


def _blocks(groups: DataFrame) -> DataFrame:
    """Groups that span components, dealt to pairs of blocks ``i <= j``: one pair unless a group is large."""
    sizes = groups.groupBy("center").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    parts = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, 8 * F.col("members") / BLOCK_BYTES)).cast("int")
    sizes = stage(sizes.where("low <> high").select("center", parts.alias("parts")))
    rows = groups.join(sizes, "center").withColumn("own", F.pmod(F.hash("cid"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "parts")


def links(sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between classes ``cid, codes``: enough of them for the components."""
    lists = stage(_lists(sets))
    about = stage(sets.mapInArrow(_describe, "cid long, n long, sketch binary"))
    # The class in most lists of others is central to its copies.
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("looks").alias("looked")).where("size > 1 and looked")
    busy = stage(lists.join(sizes.select("key", "size"), "key"))
    weight = busy.groupBy("cid").agg(F.sum("size").alias("weight"))
    centers = busy.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("c"))
    met = stage(
        busy.join(centers.select("key", F.col("c.cid").alias("center")), "key")
        .groupBy("center", "cid")
        .agg(F.max("looks").alias("looks"))
    )
    discard(lists, busy)
    told = met.join(about, "cid")
    middle = about.select(F.col("cid").alias("center"), F.col("n").alias("center_n"), F.col("sketch").alias("center_sketch"))
    close = told.where("cid <> center").join(middle, "center").where(_near("sketch", "n", "center_sketch", "center_n"))
    pairs = stage(close.select(F.col("center").alias("a"), F.col("cid").alias("b")))
    first = stage(_verified(pairs, sets))
    labels = components(first)
    groups = told.join(labels, told["cid"] == labels["node"], "left").select(
        "center", "cid", "looks", "n", "sketch", F.coalesce("component", "cid").alias("component")
    )
    fields = "center long, cid long, looks boolean, n long, sketch binary, component long, i int, j int"
    involved = stage(_blocks(groups).groupBy("center", "i", "j").applyInPandas(_involved, fields))
    wanted = stage(involved.select("cid").distinct())
    more = stage(sets.join(sent(wanted), "cid", "left_semi"))
    second = involved.join(more, "cid").groupBy("center", "i", "j").applyInPandas(_join_components, "a long, b long")
    return first.union(second)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id``.

    Shingles are runs of three words of the text with A-Z lower-cased; fewer words are one shingle.
    Documents link if the intersection of their sets has at least nine tenths of the union;
    ``component_id`` is the smallest id reachable over links, the own one included. The join is
    exact up to collisions of 64-bit hashes of shingles.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share an id
    are one document, linked by any of their texts; equal rows come out as often as they go in. Rows
    without an id are linked with nothing and have no component. Other columns are not read.
    """
    source = docs.select(quoted(id_col).alias("owner"), as_bytes(quoted(text_col)).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stage(source.mapInArrow(_sign, f"owner {kind}, n long, class binary, codes binary"))
    real = signed.where("n > 0 and owner is not null")
    first = real.groupBy("class").agg(F.min("owner").alias("rep"))
    classes = stage(first.withColumn("cid", F.monotonically_increasing_id()))
    small = sent(classes)
    match = (real["class"] == small["class"]) & (real["owner"] == small["rep"])
    sets = real.join(small, match).select("cid", "codes")
    # The same text may stand on several rows of one id.
    several = real.groupBy("owner").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("class").alias("k")).where("rows > 1")
    several = stage(several)
    if not several.isEmpty() or classes.count() > MAX_SENT:
        sets = stage(sets.dropDuplicates(["cid"]))
    names = signed.select("owner", "n", "class").join(small.select("class", "rep", "cid"), "class", "left")
    same_id = names.where("n > 0").join(several.where("k > 1"), "owner")
    # The class of the smallest own text stands for an id with several sets.
    same_id = same_id.join(same_id.groupBy("owner").agg(F.min("cid").alias("a")), "owner").select("a", F.col("cid").alias("b"))
    joined = components(links(sets).union(same_id.where("a <> b")))
    named = joined.join(classes.select("cid", "rep"), joined["node"] == classes["cid"])
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    reached = stage(named.join(least, "component").select("cid", "least"))
    done = names.join(sent(reached), "cid", "left")
    own = F.when(F.col("n") > 0, F.coalesce("least", "rep")).otherwise(F.col("owner"))
    return done.select(
        F.col("owner").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("owner").isNotNull(), own).alias("component_id"),
    )
