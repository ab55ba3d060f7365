"""BPE against the tiktoken library, and exact round trips."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

from spanwave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", "a", " ", "\n\n  \n", "hello world", "Zwölf Boxkämpfer  jagen", "x" * 5000, "ab" * 3000, "naïve 日本語 🙂🙂",
    "it's we'll <|endoftext|>", "tab\tand\x00nul", " " * 900, "1234567890" * 30, "éàü" * 500, "á́", "Mixed CASE and_snake-case",
]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_perfect_hash_is_minimal():
    words = list(bpe.read_ranks(PATH))
    table = bpe.PerfectHash(words)
    assert sorted(table.order.tolist()) == list(range(len(words)))
    assert all(table.slot(w) == s for w, s in zip(words[:5000], table.order[:5000].tolist(), strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 300])
def test_small_perfect_hash(n):
    words = [f"w{i}".encode() for i in range(n)]
    table = bpe.PerfectHash(words)
    assert [table.slot(w) for w in words] == table.order.tolist()
    assert sorted(table.order.tolist()) == list(range(n))


def test_matches_library(spark, encoding):
    rows = spark.createDataFrame([(i, t, f"x{i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    vocabulary = bpe.load(spark, PATH, public_tokenizers.PATTERN)
    done = bpe.decode(bpe.encode(rows, vocabulary), vocabulary).orderBy("doc_id").collect()
    for text, row in zip(TEXTS, done, strict=True):
        assert row.ids == encoding.encode_ordinary(text or "")
        assert bytes(row.decoded) == (text or "").encode()


def test_random_texts_match_library(encoding):
    import random

    rng = random.Random(7)
    coder = bpe.Coder(bpe.Vocabulary(bpe.read_ranks(PATH), public_tokenizers.PATTERN))
    parts = ["word", "Wörter", "it's", "don't,", "a", ",", ".", "...", "end.", "x,y", " ", "\n", "\t", "\u00a0", "\u2003", "12", "3.5", "日本", "é", "ª", "²", "\x1c", "'s", "'", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(0, 9)))
        assert list(memoryview(coder.encode(text)).cast("i")) == encoding.encode_ordinary(text), text


def test_query_matches_library(spark, encoding):
    from spanwave.llm import queries

    folder = "/root/testdata/sf0.001"
    want = {}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = encoding.encode_ordinary(row.text or "")
        joined = " ".join(map(str, ids)).encode()
        want[row.doc_id] = (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, folder).collect()}
    assert got == want


def test_empty_table(spark):
    vocabulary = bpe.load(spark, PATH, public_tokenizers.PATTERN)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(none, vocabulary), vocabulary)).count() == 0
