"""Vectors over a threshold of cosine similarity, by cells around pivots.

A bounded sample of the vectors are pivots, and each vector belongs to the cell
of its nearest one.  On the unit sphere angles are distances, so a query at
angle a from a pivot can only be similar to vectors of that cell whose own angle
lies within a -+ the threshold's angle, and to none at all beyond the cell's
largest.  Small cells are joined to groups, and both the vectors of a group and
the queries that have a cell of it left are dealt in blocks, so a task never
holds more than a block of each.  Every pair is checked with its full vectors:
the answer is that of comparing all.  How much is pruned depends on how far the
vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.scratch import staged
from factloom.shipping import ship

PIVOTS, BLOCK_BYTES, LEAST_BLOCK, SLACK = 256, 8 << 20, 256, 1e-6
SCORES = 1 << 20  # of one matrix product


def _units(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    flat = np.asarray(batch.column("v").flatten()).reshape(len(batch), -1)
    return batch.column("id"), flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _vectors(units: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * units.shape[1]), pa.array(units.ravel()))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _grouped(sizes: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: neighbouring cells together as long as they hold at most a block of vectors."""
    groups, group, held = np.zeros(len(sizes), np.int64), 0, 0
    for cell, size in enumerate(sizes):
        if held and held + size > block:
            group, held = group + 1, 0
        groups[cell], held = group, held + size
    return groups


def usable(rows: DataFrame, dims: int) -> DataFrame:
    """id and v (doubles) of the vectors with ``dims`` finite entries and a length."""
    v = F.transform("v", lambda x: x.cast("double"))
    sound = F.coalesce((F.size("v") == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < 1e150), F.lit(False))) & F.exists(v, lambda x: F.abs(x) > 1e-150), F.lit(False))
    return rows.where(sound).select(F.col("id").cast("long"), v.alias("v"))


def similar(queries: DataFrame, vectors: DataFrame, threshold: float, most: int | None = None, pivots: int = PIVOTS, block: int | None = None) -> DataFrame:
    """(query, id, similarity): the vectors (id, v) whose cosine similarity to a query (id, v) is ``threshold`` or more, itself left out.

    With ``most``, of each query the most similar so many, ties to the smaller id.
    Vectors that are null, of another length than the commonest, not finite or
    without length are similar to nothing.
    """
    spark = vectors.sparkSession
    ship(spark)
    none = spark.createDataFrame([], "query long, id long, similarity double")
    common = vectors.where("v is not null").groupBy(F.size("v").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").first()
    if common is None:
        return none
    rows, asked = usable(vectors, common.dims), usable(queries, common.dims)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # a bounded sample
    if not picked:
        return none
    centres = np.array([r.v for r in picked])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    theta = float(np.arccos(min(1.0, max(-1.0, threshold)))) + SLACK

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = _units(batch)
            angles = _angles(units, centres)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(angles[np.arange(len(cell)), cell]), ids, _vectors(units)], ["cell", "angle", "id", "v"])

    held = staged(rows.mapInArrow(placed, "cell long, angle double, id long, v array<double>"), "similar-cells")
    found = held.groupBy("cell").agg(F.max("angle").alias("reach"), F.min("angle").alias("least"), F.count("*").alias("size")).collect()  # a row a pivot
    reach, least, sizes = np.full(len(centres), -np.inf), np.full(len(centres), np.inf), np.zeros(len(centres), np.int64)
    for r in found:
        reach[r.cell], least[r.cell], sizes[r.cell] = r.reach, r.least, r["size"]
    block = block or max(LEAST_BLOCK, min(BLOCK_BYTES // (8 * common.dims), -(-int(sizes.sum()) // 8)))
    groups = _grouped(sizes, block)
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    parts = -(-np.add.reduceat(sizes, starts) // block)  # blocks of vectors of each group

    def left(units: np.ndarray) -> np.ndarray:
        """Whether a query has a cell of a group left."""
        angles = _angles(units, centres)
        return np.logical_or.reduceat((angles - theta <= reach) & (angles + theta >= least), starts, axis=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(starts), np.int64)
        for batch in batches:
            if len(batch):
                n += left(_units(batch)[1]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["group", "n"])

    shares = np.ones(len(starts), np.int64)  # blocks of queries of each group
    for r in asked.mapInArrow(counted, "group long, n long").groupBy("group").agg(F.sum("n").alias("n")).collect():  # a row a group
        shares[r.group] = max(1, -(-r.n // block))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 128):
                ids, units = _units(batch.slice(low, 128))
                q, group = np.nonzero(left(units))
                share = ((np.asarray(ids).astype(np.uint64)[q] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % shares[group]
                times = parts[group]  # a large cell is dealt in blocks, and its queries go to each
                q, group, share = np.repeat(q, times), np.repeat(group, times), np.repeat(share, times)
                part = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(part), pa.array(share), ids.take(pa.array(q)), _vectors(units[q])], ["group", "part", "share", "id", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        cell, ids, angle = (np.asarray(table.column(c)) for c in ("cell", "id", "angle"))
        units = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(table), -1)
        a, ia = units[cell < 0], ids[cell < 0]
        held = np.flatnonzero(cell >= 0)
        held = held[np.lexsort((angle[held], cell[held]))]
        b, ib, tb, cell = units[held], ids[held], angle[held], cell[held]
        bounds = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
        for low, high in zip(bounds[:-1], bounds[1:]):
            ta = _angles(a, centres[cell[low] : cell[low] + 1])[:, 0]
            near = np.flatnonzero((ta - theta <= tb[high - 1]) & (ta + theta >= tb[low]))
            near = near[np.argsort(ta[near])]
            step = max(1, SCORES // int(high - low))
            for at in range(0, len(near), step):
                here = near[at : at + step]
                first, last = low + np.searchsorted(tb[low:high], ta[here[0]] - theta), low + np.searchsorted(tb[low:high], ta[here[-1]] + theta, side="right")
                score = a[here] @ b[first:last].T
                i, j = np.nonzero((score >= threshold - 1e-12) & (ia[here][:, None] != ib[first:last]))
                yield pa.RecordBatch.from_arrays([pa.array(ia[here][i]), pa.array(ib[first:last][j]), pa.array(score[i, j])], ["query", "id", "similarity"])

    deal = spark.createDataFrame(pa.table({"cell": np.arange(len(groups)), "group": groups, "parts": parts[groups], "shares": shares[groups]}))  # a row a pivot
    dealt = held.join(deal, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    wanted = asked.mapInArrow(sent, "group long, part long, share long, id long, v array<double>").withColumns({"cell": F.lit(-1).cast("long"), "angle": F.lit(0.0)})
    columns = ["group", "part", "share", "cell", "angle", "id", "v"]
    hits = wanted.select(*columns).unionByName(dealt.select(*columns)).groupBy("group", "part", "share").applyInArrow(compared, "query long, id long, similarity double")
    if most is None:
        return hits
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
