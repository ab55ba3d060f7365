"""Source divergence against a literal version."""

import random
from collections import Counter

import numpy as np
import pytest

from spanwave.llm import queries, source_audit

FOLDER = "/root/testdata/sf0.01"


def terms_of(text: str) -> list[str]:
    chars = [c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in text]
    return "".join(c.lower() if c.isascii() else c for c in chars).split(" ")


def brute(rows: list[tuple], min_docs: int, top: int) -> list[tuple]:
    rows = [(a or "", b or "", c or "") for a, b, c in rows]
    words = [[t for t in terms_of(text) if t] for text, _, _ in rows]
    done = []
    for lang in {r[1] for r in rows}:
        held = Counter(t for w, r in zip(words, rows, strict=True) if r[1] == lang for t in set(w))
        kept = {t for t, n in held.items() if n >= min_docs}
        counts = {r[2]: Counter() for r in rows if r[1] == lang}
        for w, r in zip(words, rows, strict=True):
            if r[1] == lang:
                counts[r[2]].update(t for t in w if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(whole, t) for t in kept}
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                done += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return done


def same(got: list, want: list) -> None:
    assert sorted(map(tuple, got)) == sorted(want)


def test_documents(spark):
    docs = queries.table(spark, FOLDER, "documents")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    same(queries.op12_source_divergence(spark, FOLDER).collect(), brute(rows, 30, 50))


@pytest.mark.parametrize("held", [source_audit.HELD, 5])
def test_edges(spark, monkeypatch, held):
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "BAND_ROWS", held)
    rng = random.Random(held)
    pool = ["a", "B", "é", "É", "zz", "Zz", "ß", "日本", "q1w", "x-y", "mm"]
    rows = [(" ".join(rng.choices(pool, k=rng.randint(0, 9))), rng.choice(["en", "fr"]), rng.choice("stuv")) for _ in range(120)]
    rows += [(None, "en", "s"), ("", "en", "empty"), ("123 --", "xx", "only"), (None, None, None), ("a b", None, "s"), ("a b", "", "t")]
    rows += [("a " * 5000, "de", "long"), ("a", "de", "short"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, rank int")
    docs = docs.repartition(3)
    same(source_audit.audit(docs, min_docs=2, top=3).collect(), brute(rows, 2, 3))


def test_empty(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


@pytest.mark.parametrize("top", [1, 3])
def test_skyband(top):
    rng = np.random.default_rng(top)
    for _ in range(30):
        n = int(rng.integers(1, 80))
        here, there, place = rng.integers(0, 8, n), rng.integers(0, 8, n), rng.permutation(n)
        above = (here[None] >= here[:, None]) & (there[None] <= there[:, None]) & (place[None] < place[:, None])
        assert sorted(source_audit.skyband(here, there, place, top)) == np.flatnonzero(above.sum(axis=1) < top).tolist()
