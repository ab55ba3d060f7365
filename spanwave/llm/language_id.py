"""Language of a text: likelihood of its bytes, what its markup declares, its address and its host.

Evidence is fused as in naive Bayes:

``log P(l | all) ~ log P(text | l) * WEIGHT + log P(declared | l) + log prior(l | host, suffix)``

* text: byte trigrams against tables fitted on a bounded sample of rows with a declared language;
* declared: the declaration is right with probability ``TRUST``, else any language;
* host: the counts of the languages that text and declaration favour, by host, smoothed to the counts
  of its address suffix, and those to the counts of all rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwave.llm.storage import Batches, as_bytes, list_of, packed, quoted, stage, unpacked, with_fields, without

SAMPLE_ROWS = 400  # labelled rows a language is fitted on, at most
MIN_ROWS = 5  # labelled rows that make a declared code a language
SAMPLE_BYTES = 20_000  # bytes of a labelled row that are used
TABLE_BITS = 16
WEIGHT = 0.1  # neighbouring trigrams overlap, so the text's log likelihood counts for a tenth
TRUST = 0.9
SMOOTH = 20.0  # rows a parent prior counts for
MIN_CONFIDENCE = 0.5
MIN_LETTERS = 1  # bytes of letters that a text needs
MAX_HOSTS_SENT = 50_000  # hosts whose priors are sent to all tasks; more are joined
OUTPUTS = ("language", "confidence", "text_language", "accepted")


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Table places of all byte trigrams; A-Z count as a-z, everything that is no letter as a space."""
    low = FOLD[raw].astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def fit(docs: DataFrame, text_col: str, declared_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by table place, from at most ``sample_rows`` rows each.

    The rows are those with the smallest hash of their text, so the choice repeats. Only hashes are
    shuffled to find them.
    """
    whole = as_bytes(quoted(text_col))
    labelled = docs.select(
        F.lower(F.substring(quoted(declared_col).cast("string"), 1, 2)).alias("language"),
        F.xxhash64(whole).alias("place"),
        F.substring(whole, 1, SAMPLE_BYTES).alias("body"),
    ).where("language rlike '^[a-z]{2}$' and octet_length(body) >= 100")
    # Hashes only: the smallest of each salt, then of each language; equal texts count once.
    salted = labelled.select("language", "place").distinct().withColumn("salt", F.pmod("place", F.lit(64)))
    by_salt = Window.partitionBy("language", "salt").orderBy("place")
    by_language = Window.partitionBy("language").orderBy("place")
    ranked = salted.withColumn("n", F.row_number().over(by_salt)).where(F.col("n") <= sample_rows)
    limits = ranked.withColumn("n", F.row_number().over(by_language)).where(F.col("n") <= sample_rows)
    rows = labelled.groupBy("language").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= MIN_ROWS)
    limits = limits.join(rows, "language")
    wanted = F.lit(False)
    for row in limits.groupBy("language").agg(F.max("place").alias("limit")).collect():  # one row a language
        wanted = wanted | ((F.col("language") == row.language) & (F.col("place") <= row.limit))
    chosen = labelled.where(wanted).groupBy("language", "place").agg(F.min("body").alias("body"))
    counts: dict[str, np.ndarray] = {}
    for row in chosen.select("language", "body").toLocalIterator():
        table = counts.setdefault(row.language, np.zeros(1 << TABLE_BITS))
        table += np.bincount(trigrams(np.frombuffer(bytes(row.body), np.uint8)), minlength=1 << TABLE_BITS)
    names = sorted(counts)
    tables = [np.log((counts[n] + 0.05) / (counts[n].sum() + 0.05 * (1 << TABLE_BITS))) for n in names]
    return names, np.array(tables, np.float32).reshape(len(names), 1 << TABLE_BITS)


def _likelihood(batches: Batches, tables) -> Batches:
    model = tables.value
    count = len(model)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        sums = np.zeros((len(texts), count))
        letters = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            raw = np.frombuffer(text, np.uint8)
            letters[i] = np.count_nonzero(FOLD[raw] != 32)
            for start in range(0, max(0, len(raw) - 2), 1 << 18):
                at = trigrams(raw[start : start + (1 << 18) + 2])
                sums[i] += model[:, at].sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                list_of(sums.reshape(-1), np.full(len(texts), count), pa.float64()),
                pa.array(letters),
            ],
            [*batch.schema.names[:-1], "__text", "__letters"],
        )


def _softmax(values: Column) -> Column:
    """Exponentials of an array, scaled to add up to one."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _blend(counts: Column, parent: Column, total: Column) -> Column:
    """Counts smoothed to a parent distribution worth ``SMOOTH`` rows."""
    return F.zip_with(counts, parent, lambda n, p: (n + F.lit(SMOOTH) * p) / (total + F.lit(SMOOTH)))


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    min_confidence: float = MIN_CONFIDENCE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with ``language``, ``confidence``, ``text_language`` and ``accepted``.

    ``declared_col`` holds what the markup declares (only its first two letters count), ``host_col``
    the host; the part after its last dot is its address suffix. Either may be None.

    A declared code that fewer than ``MIN_ROWS`` rows share is no language.
    Texts without letters (null and empty ones too) have no language and are not accepted; nor is a
    text whose best language has less than ``min_confidence``. Null or unknown declarations and
    hosts are no evidence: such rows use the prior of all rows. Equal scores go to the first
    language in alphabetical order. With no labelled row at all, nothing has a language. Repeated
    rows count as often as they occur. Input columns named like the outputs are replaced.
    """
    spark = docs.sparkSession
    names, tables = fit(docs, text_col, declared_col, sample_rows) if declared_col else ([], np.zeros((0, 1 << TABLE_BITS)))
    if not names:
        kept = without(docs, *OUTPUTS)
        return kept.select(
            *[quoted(c) for c in kept.columns],
            F.lit(None).cast("string").alias("language"),
            F.lit(0.0).alias("confidence"),
            F.lit(None).cast("string").alias("text_language"),
            F.lit(False).alias("accepted"),
        )
    shared = spark.sparkContext.broadcast(tables)
    known = F.array(*[F.lit(n) for n in names])
    host = F.lower(quoted(host_col).cast("string")) if host_col else F.lit(None).cast("string")
    declared = F.lower(F.substring(quoted(declared_col).cast("string"), 1, 2))
    wrong = math.log((1 - TRUST) / len(names))
    right = math.log(TRUST + (1 - TRUST) / len(names))

    def scored(columns: list[Column]) -> DataFrame:
        rows = docs.select(
            *columns, host.alias("__host"), declared.alias("__declared"), as_bytes(quoted(text_col)).alias("__body")
        )
        done = rows.mapInArrow(partial(_likelihood, tables=shared), with_fields(rows, "__text array<double>, __letters long"))
        known_here = F.array_contains(known, F.coalesce(F.col("__declared"), F.lit("")))
        both = F.zip_with(
            "__text",
            known,
            lambda t, n: t * F.lit(WEIGHT)
            + F.when(known_here & (n == F.col("__declared")), F.lit(right)).when(known_here, F.lit(wrong)).otherwise(F.lit(0.0)),
        )
        return done.withColumn("__both", both)

    # Grouped counts: every row adds its posterior without a prior, by host.
    votes = scored([]).where(F.col("__letters") >= MIN_LETTERS).select("__host", _softmax(F.col("__both")).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(len(names))]
    hosts = stage(votes.groupBy("__host").agg(*sums))
    whole = hosts.agg(*[F.sum(f"n{i}") for i in range(len(names))]).first()
    mass = sum(x or 0.0 for x in whole)
    base = F.array(*[F.lit(((x or 0.0) + 1.0) / (mass + len(names))) for x in whole])
    suffix = F.when(F.instr("__host", ".") > 0, F.substring_index("__host", ".", -1))
    counts = F.array(*[F.col(f"n{i}") for i in range(len(names))])
    by_suffix = (
        hosts.withColumn("__suffix", suffix)
        .where("__suffix is not null")
        .groupBy("__suffix")
        .agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))])
        .select("__suffix", _blend(counts, base, F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)).alias("__parent"))
    )
    priors = (
        hosts.where("__host is not null")
        .withColumn("__suffix", suffix)
        .join(by_suffix, "__suffix", "left")
        .withColumn("__parent", F.coalesce("__parent", base))
        .select(
            F.col("__host").alias("__of"),
            _blend(counts, F.col("__parent"), F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)).alias("__prior"),
        )
    )
    if hosts.count() <= MAX_HOSTS_SENT:
        priors = F.broadcast(priors)
    rows = scored([packed(docs, *OUTPUTS).alias("given")]).join(priors, F.col("__host") == F.col("__of"), "left")
    fused = F.zip_with("__both", F.coalesce("__prior", base), lambda s, p: s + F.log(p))
    best = lambda a: F.element_at(known, F.array_position(a, F.array_max(a)).cast("int"))
    rows = rows.withColumn("__p", _softmax(fused))
    there = F.col("__letters") >= MIN_LETTERS
    return rows.select(
        *unpacked(docs, F.col("given"), *OUTPUTS),
        F.when(there, best(F.col("__p"))).alias("language"),
        F.when(there, F.array_max("__p")).otherwise(0.0).alias("confidence"),
        F.when(there, best(F.col("__text"))).alias("text_language"),
        (there & (F.array_max("__p") >= F.lit(min_confidence))).alias("accepted"),
    )


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages with ``declared`` (the lang attribute of the html element), ``host`` and ``body``.

    ``body`` is the page without scripts, styles, comments, tags and character references. Null
    pages give nulls; columns named like the outputs are replaced.
    """
    html = quoted(html_col).cast("string")
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)
    host = F.regexp_extract(quoted(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    kept = without(pages, "declared", "host", "body")
    return kept.select(
        *[quoted(c) for c in kept.columns],
        F.when(declared != "", declared).alias("declared"),
        F.when(host != "", host).alias("host"),
        bare.alias("body"),
    )
