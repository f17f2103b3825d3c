"""Token counts by a separator scan of flat token files.

The files are bare streams of token ids, of 16 bits, or of 32 where the
vocabulary or the end id needs them, in which each document ends with an end-of-document id; nothing marks
where documents start.  A stream is cut into blocks of equal size, so documents
run across blocks.  Each block is searched by itself, vectorised; a running sum
of its stream's separators and a running maximum of their places, the prefix
scan, number the documents and give the length of those that began earlier.

A text that spells an end mark is ordinary text here: its ids never hold the
end id, so a separator is always the end of a document.

Defined cases: null or empty text is its end id alone; every row is a document,
repeated rows included; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.dac import as_uri, pieces_of, put
from factloom.llm.shingles import slices
from factloom.llm.tokens import encoder
from factloom.scratch import new_path
from factloom.shipping import ship

BLOCK_IDS = 4_000_000


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 where the vocabulary and the end id fit, else 4."""
    return 2 if max(encoder(tokenizer, as_text=True).size - 1, end_id) < 1 << 16 else 4


def write_streams(docs: DataFrame, tokenizer: str, end_id: int, folder: str, width: int = 2, block: int = BLOCK_IDS) -> None:
    """Write a stream per task in blocks, and beside them which document is the n-th of a stream."""
    target, kind = as_uri(folder), f"<u{width}"
    end, full = np.array([end_id], kind).tobytes(), block * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, number, ordinal = TaskContext.get().partitionId(), 0, 0
        held = bytearray()

        def flush(least: int) -> None:
            nonlocal number
            while len(held) >= least:
                put(target, f"stream-{stream:06d}-{number:08d}.ids", held[:full])
                del held[:full]
                number += 1

        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                texts = [t or "" for t in batch.column("text")[low:high].to_pylist()]
                for coded in encoder(tokenizer, as_text=True).encode(texts):
                    held += np.frombuffer(coded, "<u4").astype(kind).tobytes()
                    held += end
                    flush(full)
                places = np.arange(ordinal, ordinal + len(texts))
                ordinal += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), stream, np.int32)), pa.array(places), batch.column("doc_id")[low:high]], ["stream", "ordinal", "doc_id"])
        flush(1)

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "stream int, ordinal long, doc_id long").write.parquet(f"{folder}.order")


def scan(spark, folder: str, end_id: int, width: int = 2) -> DataFrame:
    """(stream, ordinal, n_tokens): the tokens of each document, without its end id."""
    target = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, block in zip(batch.column("stream").to_pylist(), batch.column("block").to_pylist()):
                size, found = 0, []
                for piece in pieces_of(target, f"stream-{stream:06d}-{block:08d}.ids"):
                    ids = np.frombuffer(piece, f"<u{width}")
                    found.append(np.flatnonzero(ids == end_id) + size)
                    size += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stream], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([np.concatenate(found)], pa.list_(pa.int64()))],
                    ["stream", "block", "size", "ends"],
                )

    part = lambda i: F.regexp_extract("path", r"stream-(\d+)-(\d+)\.ids$", i).cast("int")
    blocks = spark.read.format("binaryFile").load(folder).select(part(1).alias("stream"), part(2).alias("block"))  # a listing, without contents
    found = blocks.mapInArrow(run, "stream int, block int, size long, ends array<long>")
    facts = found.select("stream", "block", "size", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    earlier = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    facts = facts.withColumn("carry", F.coalesce(F.max(F.col("base") + F.col("last")).over(earlier), F.lit(-1)))
    spans = F.transform("ends", lambda at, i: F.struct(i.cast("long").alias("i"), at.alias("at"), F.get("ends", i - 1).alias("before")))
    ends = found.select("stream", "block", F.inline(spans))
    joined = ends.join(facts.select("stream", "block", "base", "ordinal", "carry"), ["stream", "block"])
    length = F.col("base") + F.col("at") - F.coalesce(F.col("base") + F.col("before"), F.col("carry")) - 1
    return joined.select("stream", (F.col("ordinal") + F.col("i")).alias("ordinal"), length.alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int = 50256) -> DataFrame:
    """doc_id, n_tokens (without the end id) of every document, counted in its flat token file."""
    spark = docs.sparkSession
    ship(spark)
    folder, width = new_path(spark, "streams"), id_width(tokenizer, end_id)
    write_streams(docs, tokenizer, end_id, folder, width)
    order = spark.read.parquet(f"{folder}.order")
    if order.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    return order.join(scan(spark, folder, end_id, width), ["stream", "ordinal"]).select("doc_id", "n_tokens")
