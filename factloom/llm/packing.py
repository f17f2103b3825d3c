"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids (with its end id) are cut into whole windows and pieces of at
most ``cut`` ids.  The pieces are dealt to groups of about ``GROUP``; inside a
group, k-way partial partitions are merged largest difference first, the
fullest window of one with the emptiest of the other, which leaves k windows of
nearly equal fill.  k starts at the least possible number and rises whenever
the fullest window exceeds the capacity.  A group's work is bounded, so the
whole scales with the number of groups.

Defined cases: null or empty text is its end id alone; every row is a document
of its own, repeated ids included; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shingles import slices
from factloom.llm.tokens import encoder
from factloom.scratch import staged
from factloom.shipping import ship

CAPACITY, CUT, GROUP = 2048, 512, 512

PIECES = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """The pieces of every document, with the crc32 of each piece's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for low, high in slices(batch.column("text"), 1 << 20):
                out: list[tuple] = []
                ids = batch.column("doc_id")[low:high].to_pylist()
                texts = [t or "" for t in batch.column("text")[low:high].to_pylist()]
                for doc_id, body in zip(ids, encoder(tokenizer).encode(texts)):
                    body += end
                    total, start = len(body) // 4, 0
                    while start < total:
                        length = capacity if total - start >= capacity else min(cut, total - start)
                        out.append((uid, doc_id, start, length, zlib.crc32(body[4 * start : 4 * (start + length)]), total))
                        start += length
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def differenced(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: each item's window of k, and the windows' sums."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # a node is an item or two nodes in one window
    heap = []
    for i in range(n):
        fill, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        fill[0], node[0] = sizes[i], i
        heap.append((-int(sizes[i]) if k > 1 else 0, i, fill, node))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, fill_a, node_a = heapq.heappop(heap)
        _, _, fill_b, node_b = heapq.heappop(heap)
        fill, node_b = fill_a + fill_b[::-1], node_b[::-1]
        node = np.where(node_a < 0, node_b, node_a)
        for at in np.flatnonzero((node_a >= 0) & (node_b >= 0)).tolist():
            node[at] = len(left)
            left.append(int(node_a[at]))
            right.append(int(node_b[at]))
        order = np.argsort(-fill, kind="stable")
        fill, node = fill[order], node[order]
        heapq.heappush(heap, (int(fill[-1] - fill[0]), turn, fill, node))
        turn += 1
    window = np.zeros(n, np.int64)
    _, _, fill, node = heap[0]
    for w, top in enumerate(node.tolist()):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if left[x] < 0:
                window[x] = w
            else:
                stack += [left[x], right[x]]
    return window, fill


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Each item's window, with as many windows as keep all within the capacity."""
    if not len(sizes):
        return np.empty(0, np.int64)
    k, rise = max(1, -(-int(sizes.sum()) // capacity)), 1
    while True:
        window, fill = differenced(sizes, k)
        if fill.max() <= capacity:
            return window
        k, rise = min(len(sizes), k + max(1, rise // 4)), rise + 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """Every piece with its sequence and its offset there; padded_length is what the sequence takes."""
    ship(docs.sparkSession)
    cuts = staged(pieces(docs, tokenizer, end_id, capacity, cut), "pack-pieces")
    groups = max(1, -(-cuts.count() // GROUP))

    def run(table: pa.Table) -> pa.Table:
        column = {name: table.column(name).to_numpy() for name in ("uid", "length", "grp")}
        order = np.argsort(column["uid"], kind="stable")
        table, length = table.take(pa.array(order)), column["length"][order]
        part = length < capacity
        place = np.empty(len(order), np.int64)
        place[part] = windows(length[part], capacity)
        base = int(place[part].max()) + 1 if part.any() else 0
        place[~part] = base + np.arange(int((~part).sum()))
        total = np.bincount(place, weights=length).astype(np.int64)
        by_place = np.argsort(place, kind="stable")
        offset = np.empty(len(order), np.int64)
        offset[by_place] = np.cumsum(length[by_place]) - length[by_place] - np.repeat(np.cumsum(total) - total, np.bincount(place))
        padded = np.where(total & (total - 1) == 0, total, capacity)[place]
        made = {"sequence_id": (column["grp"][0].astype(np.int64) << 24) + place, "offset": offset, "padded_length": padded}
        kept = table.drop_columns(["uid", "grp"])
        return pa.table({**{name: kept.column(name) for name in kept.column_names}, **made})

    schema = PIECES.removeprefix("uid long, ") + ", sequence_id long, offset long, padded_length long"
    dealt = cuts.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(run, schema)
