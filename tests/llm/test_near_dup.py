"""Near duplicates against all pairs."""

import random

import pytest

from spanwave.llm import near_dup
from spanwave.llm.components import components


def sets_of(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows: list[tuple]) -> set[tuple]:
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared: dict[int, int] = {}
        for g in s:
            for j in index[g]:
                if j < i and rows[j][0] is not None:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    same: dict = {}
    for i, (o, _) in enumerate(rows):
        if o is not None and sets[i]:
            if o in same:
                parent[root(i)] = root(same[o])
            same[o] = i
    least: dict[int, int] = {}
    for i, (o, _) in enumerate(rows):
        if o is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), o), o)
    done = set()
    for i, (o, _) in enumerate(rows):
        c = None if o is None else least[root(i)] if sets[i] else o
        done.add((o, len(sets[i]), c, True if o is None else o == c))
    return done


def made_rows() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, hot = text(150), text(60)
    rows = [(None, " ".join(base)), (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  TWO"), (5, "one two three"), (6, "É É É É É"), (7, "é é é é é")]
    for i in range(8, 150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            own = own[: rng.randint(100, 150)]
        rows.append((i, " ".join(own)))
    for i in range(150, 220):
        rows.append((i, " ".join(text(rng.randint(10, 60)) + hot + text(rng.randint(10, 60)))))
    for i in range(220, 300):
        rows.append((i, " ".join(text(rng.randint(1, 30)))))
    a, b = " ".join(text(40)), " ".join(text(40))
    return rows + [(300, a), (301, a), (301, b), (302, b), (303, b), (302, None)]


@pytest.mark.parametrize("block", [near_dup.BLOCK, 20])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = made_rows()
    docs = spark.createDataFrame([(o, t, 1) for o, t in rows], "doc_id long, text string, component int").repartition(7)
    got = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute(rows)


def test_documents_match_all_pairs(spark):
    from spanwave.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op3_near_duplicates(spark, folder).collect()} == brute(rows)


def test_empty_and_keep_one(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __of string")
    assert {tuple(r) for r in near_dup.keep_one(docs).collect()} == {rows[0], rows[2], rows[3]}


def test_components_of_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, 1), (None, 3), (7, 5), (5, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 5: 5, 7: 5}
