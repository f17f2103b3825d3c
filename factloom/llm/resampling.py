"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are runs of 1 to n words, hashed to buckets by crc32.  A bucket's gain
is the log-likelihood ratio of the target texts to all documents, a document's
weight the sum of the gains of its features; with Gumbel noise drawn from the
hash of its id, the highest scores are a sample without replacement.

Long texts are cut at word boundaries into chunks of about ``CHUNK`` bytes, which
are dealt to all tasks.  A chunk carries the n - 1 words that follow it, and owns
the features that start in it, so each feature counts once; chunk counts and
weights are summed by document.  Ranks come from a range sort and a prefix sum
over its partitions.  The driver sees one table of bucket counts.

Defined cases: null or empty text has no words and weight 0, and is never drawn,
as any document below ``least`` words; rows that repeat a doc_id and its text are
documents of their own with equal scores and successive ranks; a null doc_id
draws its noise from the empty id and comes first among equal scores; without
target texts all gains follow from counts of 0; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import staged
from factloom.shipping import ship

N, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
CHUNK, MEMO, BATCH = 1 << 16, 1 << 18, 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lowered UTF-8: no ASCII but digits and letters
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
CHUNKS = "doc_id long, key long, chunk int, owned int, body binary"


def cut(text: bytes, n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Chunks of a lowered text: how many bytes each owns, and those with the n - 1 words that follow."""
    low = 0
    while low < len(text):
        found = BREAK.search(text, min(low + size, len(text)))
        high = found.start() if found else len(text)
        upto = high
        for _, word in zip(range(n - 1), WORD.finditer(text, high)):
            upto = word.end()
        yield high - low, text[low:upto]
        low = high


def chunks(docs: DataFrame, n: int = N, size: int = CHUNK) -> DataFrame:
    """Rows of CHUNKS: short texts whole where they are, long ones cut and dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def full() -> pa.RecordBatch:
            ids, keys, numbers, owned, bodies = zip(*rows)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((ids, keys, numbers, owned, bodies), kinds)], ["doc_id", "key", "chunk", "owned", "body"])

        for batch in batches:
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                for number, (owned, body) in enumerate(cut(text.as_py().encode().lower(), n, size)):
                    rows.append((doc_id, key, number, owned, body))
                    held += len(body)
                    if held >= BATCH:
                        yield full()
                        rows, held = [], 0
        if rows:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > size
    whole = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")
    short = rows.where(~long).select("doc_id", "key", F.lit(0).alias("chunk"), F.octet_length("text").alias("owned"), whole.alias("body"))
    return short.unionByName(rows.where(long).mapInArrow(run, CHUNKS).repartition("doc_id", "key", "chunk"))


class _Bucket(dict):
    """feature -> bucket, with a bound."""

    def __init__(self, buckets: int):
        self._buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[feature] = crc32(feature) % self._buckets
        return value


def _features(body: bytes, owned: int, n: int) -> tuple[int, list[bytes]]:
    """Words and features that start in the part that a chunk owns."""
    words = WORD.findall(body)
    mine = len(words) if owned >= len(body) else len(WORD.findall(body[:owned]))
    if n == 1:
        return mine, words[:mine]
    return mine, [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(min(mine, len(words) - k + 1))]


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bucket, held = np.zeros(buckets, np.int64), _Bucket(buckets), Counter()

        def settle() -> None:
            counts[:] += np.bincount([bucket[f] for f in held], weights=list(held.values()), minlength=buckets).astype(np.int64)
            held.clear()

        for batch in batches:
            for owned, body in zip(batch.column("owned").to_pylist(), batch.column("body")):
                held.update(_features(body.as_py(), owned, n)[1])
                if len(held) >= MEMO:
                    settle()
        if held:
            settle()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    found = chunks(texts, n).select("owned", "body").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed ratio of target to source."""
    size = len(source)
    ratio = (target + 1.0) * float(source.sum() + size) / ((source + 1.0) * float(target.sum() + size))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """doc_id, key, n_words, n_features, weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(len(gain))
        for batch in batches:
            words, features, sums = [], [], []
            for owned, body in zip(batch.column("owned").to_pylist(), batch.column("body")):
                mine, found = _features(body.as_py(), owned, n)
                words.append(mine)
                features.append(len(found))
                sums.append(int(gain[[bucket[f] for f in found]].sum()) if found else 0)
            kept = [batch.column(c) for c in ("doc_id", "key", "chunk")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "key", "chunk", "n_words", "n_features", "weight"])

    each = chunks(docs, n).mapInArrow(run, "doc_id long, key long, chunk int, n_words long, n_features long, weight long")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    rows = each.groupBy("doc_id", "key").agg(*sums, F.sum((F.col("chunk") == 0).cast("long")).alias("copies"))
    whole = [F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")]
    return rows.select("doc_id", "key", *whole, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn), n_words of every row; ``target`` has a column text."""
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = staged(weights(docs, gain, n).withColumn("score", F.col("weight") + noise), "resample-scores")
    able, order = scored.where(F.col("n_words") >= least), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("key")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = able.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = staged(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", place), "resample-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    drawn = percent * ordered.count() // 100
    rank = F.col("before") + F.col("place") + 1
    ranked = ordered.join(parts, "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
