"""Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from spanwave.llm import jaccard_join, queries

FOLDER = "/root/testdata/sf0.01"


def sets_of(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    index: dict = {}
    same: dict = {}
    for i, s in enumerate(sets):
        if rows[i][0] is None or not s:
            continue
        shared: dict[int, int] = {}
        for g in s:
            for j in index.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            index[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        if rows[i][0] in same:
            parent[root(i)] = root(same[rows[i][0]])
        same[rows[i][0]] = i
    least: dict[int, int] = {}
    for i, (o, _) in enumerate(rows):
        if o is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), o), o)
    return [(o, len(s), None if o is None else least[root(i)] if s else o) for i, ((o, _), s) in enumerate(zip(rows, sets, strict=True))]


def made_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(None, "one two three four"), (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  TWO"), (5, "one two three"), (6, "É É É"), (7, "é é é")]
    rows += [(8, "one two three four")]
    for size in (11, 14, 21, 22, 40, 60, 150, 900):
        base = text(size)
        for _ in range(30):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                own[rng.randrange(len(own))] = rng.choice(words)
            cut = rng.randint(0, max(1, size // 12))
            own = own[cut:] if rng.random() < 0.3 else own + text(cut) if rng.random() < 0.5 else own
            rows.append((len(rows), " ".join(own)))
    hot = text(60)
    rows += [(len(rows) + i, " ".join(text(rng.randint(5, 30)) + hot + text(rng.randint(5, 30)))) for i in range(60)]
    a, b = " ".join(text(40)), " ".join(text(40))
    return rows + [(1000, a), (1001, a), (1001, b), (1002, b), (1003, b), (1002, None), (1003, b), (1000, a)]


def same(got: list, want: list) -> None:
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("swap, rows, seed", [(jaccard_join.SWAP, jaccard_join.BLOCK_ROWS, 1), (0, 9, 2)])
def test_matches_all_pairs(spark, monkeypatch, swap, rows, seed):
    monkeypatch.setattr(jaccard_join, "SWAP", swap)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", rows)
    made = made_rows(seed)
    docs = spark.createDataFrame([(o, t, 1) for o, t in made], "doc_id long, text string, component_id int").repartition(5)
    same(jaccard_join.jaccard_components(docs).collect(), brute(made))


def test_documents_match_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    same(queries.op13_jaccard_join(spark, FOLDER).collect(), brute(rows))


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_SENT", 0)
    monkeypatch.setattr(jaccard_join, "MAX_ENTRIES", 0)
    made = made_rows(3)[:120]
    same(jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect(), brute(made))


def test_empty(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_some_segment_is_near():
    """Whatever two linked sets and whatever costs: a segment differs in fewer members than it is allotted."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        gone = int(rng.integers(0, n // 12 + 1))
        extra = rng.integers(0, 1 << 63, int(rng.integers(0, n // 12 + 1)), dtype=np.int64).astype(np.uint64)
        y = np.concatenate([x[gone:], extra])
        x, y = np.unique(x), np.unique(y)
        if not len(y) or not jaccard_join.linked(x, y):
            continue
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        number = jaccard_join.band_of(len(y))[0]
        own = jaccard_join.cuts(y)[0][0]
        asked = [(c, limit) for c, limit in jaccard_join.cuts(x) if c.parts == own.parts and (c.keys.size and (c.salt == own.salt).all())]
        assert len(asked) == 1 and number in (jaccard_join.band_of(len(x))[0], jaccard_join.band_of(len(x))[0] - 1)
        cut, limit = asked[0]
        given = jaccard_join.allocate(rng.integers(0, 1000, cut.parts), cut.sizes, limit + 1)
        assert given.sum() >= limit + 1
        full, less = set(own.keys.tolist()), set(own.less_one(np.ones(own.parts, bool)).tolist())
        hits = set(cut.keys[given > 0].tolist()) & full | set(cut.keys[given == 2].tolist()) & less
        assert hits | set(cut.less_one(given == 2).tolist()) & full
