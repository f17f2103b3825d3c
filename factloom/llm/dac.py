"""Directly addressable codes: token ids in chunk levels with random access.

An id is split into 8-bit chunks, lowest first.  Level 0 has a chunk of every
id; a set bit of its continuation bitmap says that the id goes on at level 1,
at the place given by the rank of that bit, and so on.  A rank directory holds
the number of set bits before every 512, so any id is read from one chunk a
level, without decoding its neighbours.

A file has the magic ``DAC1``; three little-endian u64 (ids, documents,
levels); the documents' ids (i64) and ends (u64); and for each level a u64
number of chunks, the chunks, the bitmap and the directory (u32).  A document
without an id of its own is stored as the least i64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shingles import slices
from factloom.llm.tokens import encoder
from factloom.scratch import new_path
from factloom.shipping import ship

MAGIC, WORD = b"DAC1", 512
FILE_IDS = 4_000_000
_NO_ID = -(1 << 63)


def dump(ids: np.ndarray, doc_ids: list[int], ends: list[int]) -> bytes:
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (WORD // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, WORD // 8)).sum(axis=1, dtype=np.uint32)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<3Q", len(ids), len(doc_ids), len(levels))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(ends, "<u8").tobytes(), *levels])


class Reader:
    """A file's documents and, by place, any of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        self.n, docs, levels = struct.unpack_from("<3Q", data, 4)
        at = 28
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", data, at)
            words = -(-size // WORD)
            chunks = np.frombuffer(data, np.uint8, size, at + 8)
            bits = np.frombuffer(data, np.uint8, words * WORD // 8, at + 8 + size)
            ranks = np.frombuffer(data, "<u4", words, at + 8 + size + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + size + len(bits) + 4 * words

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._ones(level, i)
        return value

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before place i."""
        _, bits, ranks = self.levels[level]
        word = i // WORD
        if word == len(ranks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        last = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
        return int(ranks[word]) + int(np.bitwise_count(bits[word * WORD // 8 : i >> 3]).sum()) + last.bit_count()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start to stop: a range of every level, found by rank; nothing else is decoded."""
        out = np.zeros(stop - start, np.uint32)
        here = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[here] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            here = here[more]
            if not len(here):
                break
            start = self._ones(level, start)
            stop = start + len(here)
        return out

    def all(self) -> np.ndarray:
        return self.ids(0, self.n)


def pieces_of(folder: str, name: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """A file's content, a piece at a time."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as file:
        while data := file.read(piece):
            yield data


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole under its final name; a repeated task writes the same again."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    context = TaskContext.get()
    draft = f"{root}/.{name}-{context.taskAttemptId() if context else 0}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{root}/{name}")


def as_uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Write the ids of every text and its end id, documents ascending, as files of about FILE_IDS ids."""
    target, end = as_uri(folder), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        body: list[bytes] = []
        keys: list[int] = []
        ends: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal number, held
            put(target, f"part-{part:06d}-{number:06d}.dac", dump(np.frombuffer(b"".join(body), "<u4"), keys, ends))
            done = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_tokens": pa.array([held], pa.int64())})
            number, held = number + 1, 0
            body.clear(), keys.clear(), ends.clear()
            return done

        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                ids = batch.column("doc_id")[low:high].to_pylist()
                texts = [t or "" for t in batch.column("text")[low:high].to_pylist()]
                for doc_id, coded in zip(ids, encoder(tokenizer).encode(texts)):
                    body.append(coded + end)
                    held += len(coded) // 4 + 1
                    keys.append(_NO_ID if doc_id is None else doc_id)
                    ends.append(held)
                    if held >= FILE_IDS:
                        yield close()
        if keys:
            yield close()

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # the second splits a repeated doc_id
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.mapInArrow(run, "part int, number int, n_tokens long").write.parquet(f"{folder}.files")


def read_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that committed tasks wrote."""
    import zlib

    target = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number in zip(batch.column("part"), batch.column("number")):
                file = Reader(b"".join(pieces_of(target, f"part-{part.as_py():06d}-{number.as_py():06d}.dac")))
                starts = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
                size = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, part.as_py(), np.int32)),
                        pa.array(np.full(size, number.as_py(), np.int32)),
                        pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == _NO_ID),
                        pa.array(starts),
                        pa.array(file.ends - starts),
                        pa.array([zlib.crc32(file.ids(a, b).astype("<u4", copy=False)) for a, b in zip(starts.tolist(), file.ends.tolist())], pa.int64()),
                    ],
                    ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    made = spark.read.parquet(f"{folder}.files")
    if made.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", 1).cast("int").alias("part"),
        F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", 2).cast("int").alias("number"),
    )  # a listing, without contents
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    among = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(among), F.lit(0)))
    bases = made.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    bases = bases.select("part", "number", (F.col("before") + F.col("inner")).alias("base"))
    rows = files.mapInArrow(run, "part int, number int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids to files in the shared folder and describe them from there.

    Defined cases: null or empty text is its end id alone; a null doc_id sorts
    first; rows with one doc_id follow one another by the hash of their text; an empty
    table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    folder = new_path(docs.sparkSession, "dac")
    write_files(docs, tokenizer, end_id, folder)
    return read_files(docs.sparkSession, folder)
