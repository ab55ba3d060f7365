"""Repeated strings against a count of all of them."""

import random

import numpy as np
import pytest

from spanwave.llm import suffix_dedup as sd


def brute(rows: list[tuple], length: int) -> list[tuple]:
    first: dict[bytes, tuple] = {}
    for owner, text in rows:
        raw = (text or "").encode()
        if owner is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(first.get(s, (owner, i)), (owner, i))
    done = []
    for owner, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1) if owner is not None else ():
            if first[raw[i : i + length]] < (owner, i):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        done.append((owner, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(done, key=repr)


def made_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)]
    whole = text(120)
    rows = [(None, passages[0]), (0, None), (1, ""), (2, "short"), (3, "x" * 400), (4, "ab" * 300), (5, passages[1] * 3)]
    for i in range(6, 60):
        kind = rng.random()
        if kind < 0.2:
            rows.append((i, whole))
        elif kind < 0.5:
            cut = rng.randint(0, len(whole) - 1)
            rows.append((i, whole[:cut] + rng.choice(["", "Z", "ZZ"]) + whole[cut + rng.randint(0, 2) :]))
        else:
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            rows.append((i, text(rng.randint(0, 60)) + p[a : len(p) - rng.randint(0, 30)] + text(rng.randint(0, 60))))
    return rows + [(7, whole[:300] + "tail"), (8, whole)]


@pytest.mark.parametrize("block", [sd.BLOCK, 3])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "SHARD_BYTES", 500)
    rows = made_rows(block)
    docs = spark.createDataFrame([(o, t, "clash") for o, t in rows], "doc_id long, text string, core string").repartition(5)
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in sd.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows, sd.LENGTH)


def test_copies_of_a_hot_passage_never_share_a_task(spark, monkeypatch):
    """Equal strings in different surroundings: each task of the merge sees a string once."""
    compare = sd._compare

    def guarded(batches, length):
        batches = list(batches)
        bodies = [b for batch in batches for b in batch.column("bytes").to_pylist()]
        assert len(set(bodies)) == len(bodies)
        yield from compare(batches, length)

    monkeypatch.setattr(sd, "BLOCK", 3)
    monkeypatch.setattr(sd, "_compare", guarded)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(104)
    rows = [(i, word(rng.randint(0, 150)) + passage + word(rng.randint(0, 150))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in sd.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows, sd.LENGTH)


def test_empty_table_and_long_text(spark, monkeypatch):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcd efgh") for _ in range(30_000))
    monkeypatch.setattr(sd, "PIECE", 4000)
    rows = [(1, text), (2, text[100:20_000] + "!" + text[20_500:])]
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == brute(rows, sd.LENGTH)


def test_merge_gives_order_and_common_prefixes(monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", 60)
    rng = np.random.RandomState(3)
    bodies = [bytes(rng.randint(97, 99, rng.randint(5, 40)).astype(np.uint8)) for _ in range(20)]
    length = 6
    interval, body, offset = sd.repeated(bodies, length)
    got: dict[int, set] = {}
    for i, b, o in zip(interval, body, offset, strict=True):
        got.setdefault(i, set()).add((b, o))
    want: dict[bytes, set] = {}
    for b, raw in enumerate(bodies):
        for o in range(len(raw) - length + 1):
            want.setdefault(raw[o : o + length], set()).add((b, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_common_prefixes_are_exact(kind):
    rng = np.random.RandomState(5)
    bodies = [bytes(rng.randint(97, 99, rng.randint(1, 30)).astype(np.uint8)) for _ in range(25)] + [b"aaaa", b"aaaa"]
    begins = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])])
    text = (np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.uint16) + 1).astype(kind)
    text[begins[1:] - 1] = 0
    order, common = sd.merge(text, begins[[0, 9, 10, len(bodies)]], 12)
    whole = b"\0".join(bodies) + b"\0"
    suffix = lambda i: whole[i : whole.index(b"\0", i)]
    got = [suffix(i)[:12] for i in order]
    assert sorted(order) == list(range(len(text)))
    assert got == sorted(got)
    for i in range(1, len(got)):
        a, b = got[i - 1], got[i]
        assert common[i] == next((k for k in range(12) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 12)
