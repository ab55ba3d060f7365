"""Lines, shards, benchmark leaks, languages and the whole pipeline against literal versions."""

import hashlib
import random

import pytest

import corpus_pipeline
from spanwave.llm import bloom, decontaminate, language_id, line_dedup, queries, sharding
from tests import compare
from tests.llm.test_near_dup import brute as near_brute

FOLDER = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def dedup(rows: list[tuple], chars: int = 20, docs: int = 3) -> list[tuple]:
    holders: dict[str, set] = {}
    for owner, text in rows:
        if owner is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= chars:
                    holders.setdefault(key(line), set()).add(owner)
    done = []
    for owner, text in rows:
        lines = (text or "").split("\n")
        gone = lambda l: owner is not None and len(holders.get(key(l), ())) >= docs and owner < max(holders[key(l)])  # noqa: E731, B023, E741
        kept = [x for x in lines if not gone(x)]
        done.append((owner, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return done


def test_lines(spark):
    long = ["A line of Many code points %d" % i for i in range(4)]
    rows = [(None, long[0]), (0, None), (1, ""), (2, "\n\n"), (3, "é" * 19), (4, "é" * 19), (5, "é" * 19), (6, "É" * 20), (7, "é" * 20), (8, "é" * 20)]
    rng = random.Random(1)
    for i in range(9, 40):
        lines = [rng.choice(["", "  ", "\t"]) + rng.choice([long[0], long[0].upper(), *long, f"own line number {i} of this"]) + rng.choice(["", "\r", " "]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines)))
    rows += [(12, long[1]), (12, long[1]), (50, "x" * 200_000 + "\n" + long[3])]
    docs = spark.createDataFrame([(o, t, 5, "k") for o, t in rows], "doc_id long, text string, n_lines int, key string").repartition(5)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped, r.key) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted([(*r, "k") for r in dedup(rows)], key=repr)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", bloom.MIN_BITS)
    monkeypatch.setattr(bloom, "FLUSH", 50)
    rows = [(i, f"this line is found in all documents\nand this one only in number {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()) == sorted(dedup(rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert compare.difference(got, compare.connect(FOLDER).execute(queries.ORACLES[name]).df()) is None


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(400)] + [(7, "y" * n) for n in range(50, 150)]
    rows += [(None, "z" * n) for n in range(60)] + [(3, None), (9, "same" * 50)] + [(9, "same" * 50)] * 8 + [(11, "large" * 900)]
    docs = spark.createDataFrame([(o, t, 1) for o, t in rows], "doc_id long, text string, shard int").repartition(3)
    limit = 1000
    got = sharding.assign_shards(docs, limit=limit).collect()
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=repr) == sorted(((o, len(t or "")) for o, t in rows), key=repr)
    size: dict[str, int] = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(size[r.shard] == r.shard_bytes and len(r.shard) == r.depth and r.fits == (r.shard_bytes <= limit) for r in got)
    names = set(size)
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # a directory: no prefix of another
    for name in names:  # only buckets over the limit were split
        if name:
            assert sum(s for n, s in size.items() if n.startswith(name[:-1])) > limit
    assert {r.doc_id for r in got if not r.fits} == {9, 11}
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.assign_shards(docs).collect()} == {""}


def distance(item: str, text: str) -> tuple[int, int]:
    """Smallest edit distance to a substring and its first end, by the full table."""
    column = list(range(len(item) + 1))
    best = (column[-1], 0)
    for j, c in enumerate(text, 1):
        above = [0]
        for i, d in enumerate(item, 1):
            above.append(min(column[i - 1] + (c != d), column[i] + 1, above[i - 1] + 1))
        column = above
        best = min(best, (column[-1], j))
    return best


def leaks(docs: list[tuple], items: list[tuple], share: float) -> set:
    found = {}
    for owner, text in docs:
        text = decontaminate.normal(text or "")
        for name, item in items:
            item = decontaminate.normal(item or "")
            if item and text:
                d, end = distance(item, text)
                if d <= int(len(item) * share):
                    found[owner, name] = min(found.get((owner, name), (d, end)), (d, end))
    return {(*k, *v) for k, v in found.items()}


def test_leaks(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(8, 30))) for i in range(12)] + [(20, None), (21, ""), (22, "tiny"), (3, text(9))]

    def edited(item: str) -> str:
        own = list(item)
        for _ in range(rng.randint(0, max(1, len(own) // 12))):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
        return "".join(own)

    docs = [(None, items[0][1]), (0, None), (1, ""), (2, "tin"), (3, "a TINY one"), (4, items[1][1].upper().replace(" ", " \n\t"))]
    for i in range(5, 60):
        docs.append((i, text(rng.randint(0, 25)) + " " + edited(rng.choice(items[:12])[1]) + " " + text(rng.randint(0, 25))))
    docs += [(5, items[2][1]), (70, (items[4][1] + " ") * 3)]
    frame = spark.createDataFrame([(o, t, 1) for o, t in docs], "doc_id long, text string, item int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items, decontaminate.EDIT_SHARE)
    assert {tuple(r) for r in decontaminate.find_leaks(frame, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {tuple(r) for r in decontaminate.find_leaks(frame, bench).collect()} == want
    held = {r[0] for r in want}
    kept = decontaminate.remove_leaks(frame, bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([d for d in docs if d[0] is None or d[0] not in held], key=repr)
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_distance_random():
    rng = random.Random(8)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        budget = rng.randint(0, len(item))
        d, end = distance(item, text)
        got = decontaminate.best_match(item, text, budget)
        assert got == ((d, end) if d <= budget and (d, end) != (len(item), 0) else got)
        assert (got is None) == (d > budget) or d == len(item)


def test_languages_held_out(spark):
    """Tables fitted on one half of the labels name the language of the other half."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    half = docs.selectExpr("doc_id", "text", "source", "lang AS truth", "CASE WHEN hash(doc_id) % 2 = 0 THEN lang END AS lang")
    rows = [r for r in language_id.identify(half).collect() if r.lang is None and len(r.text) > 30]
    assert len(rows) > 300
    assert sum(r.language == r.truth for r in rows) >= 0.97 * len(rows)


def test_language_cases(spark):
    english, german = "the house of the king and the sea with that story " * 4, "und der junge mann ging nicht auf die schöne straße " * 4
    turned = lambda text, i: " ".join(text.split()[i:] + text.split()[:i])
    rows = [(i, turned(english, i), "en", "a.com") for i in range(8)] + [(i, turned(german, i), "de", "b.de") for i in range(8, 16)]
    rows += [(20, None, "en", "a.com"), (21, "", None, None), (22, "12 34 !!", "de", "b.de"), (23, german, None, "new.de"), (24, english, "xx", None), (25, german, "en", "b.de"), (0, english, "en", "a.com")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, language int").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [got[i].language for i in (0, 9, 23, 24)] == ["en", "de", "de", "en"] and got[25].text_language == "de"
    assert all(got[i].language is None and not got[i].accepted and got[i].confidence == 0 for i in (20, 21, 22))
    assert all(got[i].accepted for i in (0, 9, 23, 24))
    bare = language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 2)))
    assert {r.accepted for r in bare.collect()} == {False}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_host_prior_decides(spark):
    """An undecided text goes the way of its host, and an unknown host that of its suffix."""
    english, german = "the house of the king and the sea with that story " * 4, "und der junge mann ging nicht auf die schöne straße " * 4
    rows = [(i, english, "en", "news.com") for i in range(40)] + [(i, german, "de", "blatt.de") for i in range(40, 80)]
    rows += [(90, "xq", None, "news.com"), (91, "xq", None, "blatt.de"), (92, "xq", None, "other.de"), (93, "xq", None, "other.com")]
    got = {r.doc_id: r.language for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i] for i in (90, 91, 92, 93)] == ["en", "de", "de", "en"]


def test_page_evidence(spark):
    rows = [("http://u@A.example.DE:80/x", "<html LANG='de-AT'><script>var a;</script><p>eins &amp; zwei<!-- no --></html>"), (None, None), ("nowhere", "<html>")]
    got = [tuple(r) for r in language_id.page_evidence(spark.createDataFrame(rows, "url string, html string")).select("declared", "host", "body").collect()]
    assert got[0][:2] == ("de", "A.example.DE") and got[0][2].split() == ["eins", "zwei"]
    assert got[1] == (None, None, None) and got[2][:2] == (None, None)


def test_pipeline(spark):
    """Every stage over what the one before kept, against literal versions; then the digests."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    current = {r.doc_id: r.text for r in docs.collect()}
    frame = docs
    for name in ("language_id", "line_dedup", "near_duplicates", "decontamination"):
        frame = steps[name](spark, frame, FOLDER)
        assert frame.columns == docs.columns
        got = {r.doc_id: r.text for r in frame.collect()}
        if name == "language_id":
            want = got
            assert set(got) <= set(current) and len(got) > 0.95 * len(current)
        elif name == "line_dedup":
            want = {o: t for o, t, _, _ in dedup(list(current.items()))}
        elif name == "near_duplicates":
            kept = {o for o, _, _, keep in near_brute(list(current.items())) if keep}
            want = {o: t for o, t in current.items() if o in kept}
        else:
            whole = [decontaminate.normal(t) for _, t in items]
            gone = {o for o, t in current.items() if any(i in decontaminate.normal(t or "") for i in whole)}
            assert gone and not gone & set(got)
            want = got
        assert got == want
        current = got
    rows = steps["byte_bpe"](spark, frame, FOLDER).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {o: hashlib.sha256((t or "").encode()).hexdigest() for o, t in current.items()}


def test_pipeline_cases(spark):
    """Nulls, repeats, an empty table and clashing column names pass every stage."""
    rows = [(None, None, None, None, None, 1), (1, None, "en", "s", 0, 2), (2, "", "en", "s", 0, 3)]
    rows += [(i, "the house of the king and the sea with that story " * 3 + f"number {i}", "en", "s", 9, i) for i in (3, 4, 4, 5)]
    rows += [(6, "long word " * 30_000, "en", None, 9, 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, __of int"
    for given in (rows, rows[:3], []):
        frame = spark.createDataFrame(given, columns)
        for name, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, FOLDER)
            if name != "byte_bpe":
                assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "__of"]
        assert frame.count() <= len(given)
