"""Extendible hashing of documents into shards of bounded size, by DataFrame operations only.

The directory maps prefixes of a key's hash to shards. A bucket that is over the limit splits on its
next bit; buckets within it stay whole. Since a bucket's bytes only fall as its prefix grows, the
split that stops at each key is the shortest prefix whose bytes fit, which needs no step-by-step
splitting: cells of a few more bits than the mean load asks for are summed over all their prefixes
at once. Cells still over the limit, and only those, take further bits in the next round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwave.llm.storage import quoted, stage

LIMIT = 64 << 20
SPARE_BITS = 4  # bits of the first cells beyond the mean load
ROUND_BITS = 12  # bits that the second round adds; later ones add twice as many each
MAX_BITS = 240  # bits of the hashes of id and text together


def _bits(digest: Column) -> Column:
    """240 bits of 60 hexadecimal digits as a string of 0 and 1."""
    return F.concat(*[F.lpad(F.conv(F.substring(digest, i, 15), 16, 2), 60, "0") for i in (1, 16, 31, 46)])


def _split(cells: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    """``cell, shard, depth, shard_bytes`` for the shortest prefix of ``least`` to ``most`` bits that fits.

    Cells that fit at no length have a null shard.
    """
    lengths = F.explode(F.sequence(F.lit(least), F.lit(most)))
    prefixes = cells.select("cell", "cell_bytes", lengths.alias("depth")).withColumn(
        "shard", F.substring(F.col("cell"), F.lit(1), F.col("depth"))
    )
    sums = prefixes.groupBy("depth", "shard").agg(F.sum("cell_bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    found = prefixes.select("cell", "depth", "shard").join(sums, ["depth", "shard"])
    best = found.groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("b"))
    return cells.select("cell").join(best.select("cell", "b.*"), "cell", "left")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, shard, depth, shard_bytes, fits``.

    ``shard`` is the hash prefix in bits (empty if all documents fit one shard), ``depth`` its
    length, ``shard_bytes`` the bytes of the shard's texts, at most ``limit`` where ``fits``.

    The hash is that of the id; a shard that all 120 bits leave too large goes on with the hash of
    the text, so one id, or none, on many rows still splits. What neither splits (a text above the
    limit, equal rows) keeps all bits and has ``fits`` false. Null texts have no bytes; null ids hash
    as empty. Repeated rows are rows of their own. Other columns are not read.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    key = F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")
    body = F.coalesce(quoted(text_col).cast("string").cast("binary"), F.lit(b"").cast("binary"))
    rows = stage(
        docs.select(
            quoted(id_col).alias("owner"),
            F.octet_length(body).cast("long").alias("n_bytes"),
            F.concat(*[F.substring(F.md5(x), 1, 30) for x in (key, body)]).alias("digest"),
        )
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    least, most = 0, min(MAX_BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS)
    step = ROUND_BITS
    done: list[DataFrame] = []
    while True:
        cut = rows.select("owner", "n_bytes", "digest", F.substring(_bits(F.col("digest")), 1, most).alias("cell"))
        cells = cut.groupBy("cell").agg(F.sum("n_bytes").alias("cell_bytes"))
        places = stage(_split(cells, least, most, limit))
        done.append(cut.join(places.where("shard is not null"), "cell"))
        left = places.where("shard is null")
        if left.isEmpty():
            break
        if most == MAX_BITS:
            whole = F.length("cell").alias("depth")
            done.append(cut.join(left.select("cell"), "cell").join(stage(cells), "cell").select("owner", "n_bytes", F.col("cell").alias("shard"), whole, F.col("cell_bytes").alias("shard_bytes")))
            break
        rows = stage(cut.join(left.select("cell"), "cell").drop("cell"))
        least, most, step = most + 1, min(MAX_BITS, most + step), 2 * step
    result = None
    for frame in done:
        frame = frame.select(
            F.col("owner").alias(id_col), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes"
        )
        result = frame if result is None else result.unionByName(frame)
    return result.withColumn("fits", F.col("shard_bytes") <= limit)
