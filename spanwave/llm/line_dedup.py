"""Removal of lines that many documents repeat, found with two Bloom filters."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from spanwave.llm import bloom
from spanwave.llm.storage import Batches, as_bytes, packed, quoted, stage, unpacked, without_names

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: ends stripped of white space, A-Z lower-cased."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def long_enough(key: bytes, chars: int) -> bool:
    if len(key) < chars:
        return False
    return len(key) >= 4 * chars or len(key.decode("utf-8", "replace")) >= chars


def distinct_keys(text: bytes, chars: int) -> list[bytes]:
    return [key for key in dict.fromkeys(line_keys(text)) if long_enough(key, chars)]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


def _fill(batches: Batches, bits: int, chars: int) -> Batches:
    def hashed():
        for batch in batches:
            for text in batch.column("body").to_pylist():
                yield hashes_of(distinct_keys(text, chars))

    for rows in bloom.fill(hashed(), bits):
        yield pa.RecordBatch.from_pandas(rows, SUMMARY, preserve_index=False)


SUMMARY = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _suspects(batches: Batches, filled, chars: int) -> Batches:
    for batch in batches:
        owners, keys = [], []
        for owner, text in zip(batch.column("owner").to_pylist(), batch.column("body").to_pylist(), strict=True):
            found = distinct_keys(text, chars)
            keys += found
            owners += [owner] * len(found)
        keep = np.flatnonzero(bloom.may_repeat(hashes_of(keys), filled.value))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in keep], pa.binary()), pa.array([owners[i] for i in keep], batch.column("owner").type)],
            ["key", "owner"],
        )


REWRITTEN = (
    T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType())
)


@F.pandas_udf(REWRITTEN)
def _rewrite(body: pd.Series, drops: pd.Series) -> pd.DataFrame:
    texts, lines, dropped = [], [], []
    for text, lost in zip(body, drops, strict=True):
        own = text.split(b"\n")
        lines.append(len(own))
        if lost is not None and len(lost):
            gone = set(lost)
            own = [raw for raw, key in zip(own, line_keys(text), strict=True) if key not in gone]
        dropped.append(lines[-1] - len(own))
        texts.append(b"\n".join(own).decode("utf-8", "replace"))
    return pd.DataFrame({"text": texts, "n_lines": lines, "n_dropped": dropped})


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and ``n_lines``, ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents stays only in the document with the largest id.

    The Bloom pair is filled in a first scan; a second scan sends only lines that may be repeated to
    the exact count by whole key. A third joins the few confirmed lines to their documents.

    Null or empty text is one empty line and stays as it is. Rows that share an id are one document.
    Rows without an id lose nothing and count for nothing. Equal lines in the kept document all
    stay. Input columns named ``n_lines`` or ``n_dropped`` are replaced; all others pass unchanged.
    """
    spark = docs.sparkSession
    source = docs.select(quoted(id_col).alias("owner"), as_bytes(quoted(text_col)).alias("body"))
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = bloom.bits_for(size // (min_chars + 1), 6)  # a line that counts has at least min_chars bytes and its end
    pairs = source.select("body").mapInArrow(partial(_fill, bits=bits, chars=min_chars), bloom.SCHEMA)
    filled = bloom.twice_filter(pairs, bits, spark)
    kind = docs.schema[id_col].dataType.simpleString()
    suspects = stage(
        source.where("owner is not null").mapInArrow(
            partial(_suspects, filled=filled, chars=min_chars), f"key binary, owner {kind}"
        )
    )
    # Written first, so that the join deals both sides itself and can split the keys of hot lines.
    confirmed = stage(
        suspects.groupBy("key")
        .agg(F.count_distinct("owner").alias("n"), F.max("owner").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("key", "last")
    )
    drops = (
        suspects.join(confirmed, "key")
        .where(F.col("owner") < F.col("last"))
        .groupBy(F.col("owner").alias("holder"))
        .agg(F.collect_set("key").alias("drops"))
    )
    lost = ("n_lines", "n_dropped")
    rows = docs.select(
        packed(docs, text_col, *lost).alias("given"),
        quoted(id_col).alias("owner"),
        F.when(quoted(text_col).isNotNull(), as_bytes(quoted(text_col))).alias("body"),
    )
    joined = rows.join(drops, F.col("owner") == F.col("holder"), "left")
    done = joined.select("given", "body", _rewrite(F.coalesce("body", F.lit(b"")), F.col("drops")).alias("done"))
    text = F.when(F.col("body").isNotNull(), F.col("done.text")).alias(text_col)
    columns = {c.lower(): col for c, col in zip(without_names(docs, text_col, *lost), unpacked(docs, F.col("given"), text_col, *lost), strict=True)}
    return done.select(
        *[columns.get(c.lower(), text) for c in without_names(docs, *lost)],
        F.col("done.n_lines").alias("n_lines"),
        F.col("done.n_dropped").alias("n_dropped"),
    )
