"""MinHash near-dedup by a chosen-path set similarity join.

Every document is a set of k-word shingles.  Documents with the same set form
one class.  In each of ``trees`` independent trees a class follows the path of
its minwise tokens: its node at depth d is the hash of the tokens chosen at the
depths 1 to d.  A node with at most ``leaf`` classes is compared exhaustively;
a larger one branches on, down to ``depth``.  Two sets of similarity J stay in
one node of depth d with probability J^d, so all trees miss a pair with
probability (1 - J^d)^trees.  The number of trees follows from the threshold: a
pair at the threshold that stays among large nodes down to the last depth is
missed with probability ``LOSS`` = 1e-4 at most.  At depth 5 these are 16 trees
for J = 0.85 (loss 8.4e-5) and 24 for J = 0.8 (7.3e-5); pairs whose nodes are
small earlier, and pairs of higher similarity, are missed less often.

Nodes that are still large at the last depth hold groups of near copies.  They
are searched without a cap: every member meets a few pivots, which joins the
bulk of a group in one component; then each member outside the node's largest
component meets every member of another component, in blocks of bounded size.

Candidates pass a size test, which is exact, and a sketch test that drops a
pair over the threshold with probability below 1e-9.  Links come from the full
sets.  Components spread by least labels and pointer jumping over tables in the
shared folder; nothing of the corpus reaches the driver.

Defined cases: null text, empty text and white space alone have no shingles,
are linked with nothing and stay; different texts under one doc_id are documents
of their own, which text_key tells apart, and each links by its own text; rows
that repeat doc_id and text share one answer; an empty table gives an empty
result; other columns are not read.  Rows with a null doc_id stand for
themselves: component_id null, kept true.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shingles import mix, odd_multipliers, shingle_hashes, slices
from factloom.scratch import staged
from factloom.shipping import ship

DEPTH, LEAF, PIVOTS, LOSS = 5, 40, 6, 1e-4
BLOCK, COLUMNS = 256, 4096
_U = np.uint64


def trees_for(similarity: float, depth: int = DEPTH, loss: float = LOSS) -> int:
    """The least number of trees that all miss a pair of this similarity at this depth with probability ``loss`` at most."""
    return max(1, math.ceil(math.log(loss) / math.log1p(-(similarity**depth)))) if similarity < 1 else 1


def _bound(n: int, similarity: float) -> int:
    """Agreements of n minhashes that a pair over the threshold has, but for 1e-9."""
    return max(0, int(n * (similarity - 6.5 * (similarity * (1 - similarity) / n) ** 0.5)))


def _row_sets(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, and their numbers."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.bincount(row[first], minlength=len(sizes))


def sketches(docs: DataFrame, k: int, trees: int, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key, n (set size), s1, s2 (128 bits of the set), paths (a node per tree and depth), sketch."""
    factors = odd_multipliers(trees * depth, seed=2024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                ids, texts = batch.column("doc_id")[start:stop], batch.column("text")[start:stop]
                flat, sizes = _row_sets(*shingle_hashes(texts, k))
                some = sizes > 0
                s1, s2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                low = np.zeros((len(sizes), trees * depth), np.uint64)
                if some.any():
                    heads = (np.cumsum(sizes) - sizes)[some]
                    s1[some] = np.add.reduceat(mix(flat ^ _U(0xA5A5A5A5)), heads)
                    s2[some] = np.add.reduceat(mix(flat + _U(0x7F4A7C15)), heads)
                    for h, factor in enumerate(factors):
                        low[some, h] = np.minimum.reduceat(flat * factor, heads)
                token = mix(low + np.arange(trees * depth, dtype=np.uint64))
                node = np.empty_like(token)
                for d in range(depth):
                    at = np.arange(trees) * depth + d
                    node[:, at] = mix(token[:, at] + (node[:, at - 1] * _U(0x9E3779B97F4A7C15) if d else _U(0)))
                rows = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        batch.column("text_key")[start:stop],
                        pa.array(sizes.astype(np.int64)),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(rows + 1, dtype=np.int32) * trees * depth),
                            pa.array(node.reshape(-1).view(np.int64)),
                        ),
                        pa.array([x.tobytes() for x in (token >> _U(56)).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n", "s1", "s2", "paths", "sketch"],
                )

    schema = "doc_id long, text_key long, n long, s1 long, s2 long, paths array<long>, sketch binary"
    return docs.mapInArrow(run, schema)


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """cls, items (the sorted distinct shingle hashes) of rows of cls and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                flat, sizes = _row_sets(*shingle_hashes(batch.column("text")[start:stop], k))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("cls")[start:stop], items], ["cls", "items"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, items array<long>")


def _members(reps: DataFrame, trees: int, depth: int, leaf: int) -> DataFrame:
    """(node, size, cls): the first small node of each class and tree, or the last large one."""
    spread = lambda level: F.array(*[F.struct(F.lit(t).alias("tree"), F.col("paths")[t * depth + level].alias("node")) for t in range(trees)])
    top = reps.select("cls", F.inline(spread(0)))
    count = top.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    top = staged(top.join(count, "node"), "near-top")
    deeper = top.where(F.col("size") > leaf).select("cls", "tree")
    levels = F.transform(
        F.sequence(F.lit(1), F.lit(depth - 1)),
        lambda d: F.struct(d.alias("level"), F.get(F.col("paths"), F.col("tree") * depth + d).alias("node")),
    )
    below = deeper.join(reps.select("cls", "paths"), "cls").select("cls", "tree", F.inline(levels))
    sizes = below.groupBy("node").agg(F.count("*").alias("size"))
    found = (
        below.join(sizes, "node")
        .groupBy("cls", "tree")
        .agg(F.min_by(F.struct("node", "size"), F.struct(F.col("size") > leaf, F.when(F.col("size") > leaf, -F.col("level")).otherwise(F.col("level")))).alias("at"))
        .select("cls", "at.node", "at.size")
    )
    return top.where(F.col("size") <= leaf).select("cls", "node", "size").unionByName(found.where("size > 1"))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


PAIR = "a long, b long, best boolean"


def _leaf_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of small nodes that pass both tests; best: the closest earlier member of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, best = [], [], []
            for group in batch.column("group"):
                rows = sorted((x["cls"], x["n"], x["sketch"]) for x in group.as_py())
                ids, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
                marks = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
                least = _bound(marks.shape[1], num / den)
                for j in range(1, len(rows)):
                    same = _agree(marks[:j], marks[j])
                    fit = (same >= least) & (den * np.minimum(n[:j], n[j]) >= num * np.maximum(n[:j], n[j]))
                    if fit.any():
                        top = int(np.argmax(np.where(fit, same, -1)))
                        hit = np.flatnonzero(fit)
                        a += ids[hit].tolist()
                        b += [int(ids[j])] * len(hit)
                        best += (hit == top).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(best, pa.bool_())], ["a", "b", "best"])

    groups = members.groupBy("node").agg(F.collect_list(F.struct("cls", "n", "sketch")).alias("group"))
    return groups.select("group").mapInArrow(run, PAIR)


def _star_pairs(members: DataFrame, hubs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each member with its node's hubs (at most a constant number) that pass both tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, best = [], [], []
            for x in batch.to_pylist():
                mark = np.frombuffer(x["sketch"], np.uint8)
                found = []
                for hub in x["hubs"]:
                    if hub["cls"] != x["cls"] and hub["comp"] != x["comp"] and den * min(hub["n"], x["n"]) >= num * max(hub["n"], x["n"]):
                        same = int(_agree(np.frombuffer(hub["sketch"], np.uint8), mark))
                        if same >= _bound(len(mark), num / den):
                            found.append((same, hub["cls"]))
                for i, (_, hub) in enumerate(sorted(found, reverse=True)):
                    a.append(min(hub, x["cls"]))
                    b.append(max(hub, x["cls"]))
                    best.append(i == 0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(best, pa.bool_())], ["a", "b", "best"])

    return members.join(hubs, "node").select("cls", "comp", "n", "sketch", "hubs").mapInArrow(run, PAIR)


def _block_links(opened: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of large nodes, from the full sets.

    The members outside a node's main component are dealt to blocks, and so are
    all members; a task holds one block of either kind and counts common items
    of all its pairs as a product of 0/1 matrices over the items both have.  One
    link of each pair of components is enough and is returned.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("minor").to_numpy(zero_copy_only=False)
        ids, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
        items = table.column("items").combine_chunks()
        size, flat = np.asarray(pc.list_value_length(items)), items.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        code, column = np.unique(flat, return_inverse=True)
        left = part[row]
        shared = np.flatnonzero(np.bincount(column[left], minlength=len(code)).astype(bool) & np.bincount(column[~left], minlength=len(code)).astype(bool))
        place = np.full(len(code), -1)
        place[shared] = np.arange(len(shared))
        column = place[column]
        slot = np.where(part, np.cumsum(part) - 1, np.cumsum(~part) - 1)
        both = np.zeros((int(part.sum()), int((~part).sum())), np.float32)
        for low in range(0, len(shared), COLUMNS):
            inside = (column >= low) & (column < low + COLUMNS)
            x, y = np.zeros((both.shape[0], COLUMNS), np.float32), np.zeros((both.shape[1], COLUMNS), np.float32)
            x[slot[row[inside & left]], column[inside & left] - low] = 1
            y[slot[row[inside & ~left]], column[inside & ~left] - low] = 1
            both += x @ y.T
        both = both.astype(np.int64)
        fit = den * both >= num * (size[part][:, None] + size[~part][None, :] - both)
        fit &= comp[part][:, None] != comp[~part][None, :]
        i, j = np.nonzero(fit)
        _, one = np.unique(np.stack([comp[part][i], comp[~part][j]]), axis=1, return_index=True)
        u, v = ids[part][i[one]], ids[~part][j[one]]
        return pa.table({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    deal = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), blocks(n)).cast("int")
    minor = F.col("size") - F.col("most")
    rows = opened.select("node", "cls", "comp", "main", "size", minor.alias("minors"))
    left = rows.where("comp <> main").withColumn("i", deal(F.col("minors"), 1)).withColumn("j", F.explode(F.sequence(F.lit(0), blocks(F.col("size")) - 1)))
    right = rows.withColumn("j", deal(F.col("size"), 2)).withColumn("i", F.explode(F.sequence(F.lit(0), blocks(F.col("minors")) - 1)))
    dealt = left.select("node", "i", "j", "cls", "comp", F.lit(True).alias("minor")).unionByName(right.select("node", "i", "j", "cls", "comp", F.lit(False).alias("minor")))
    return dealt.join(sets, "cls").groupBy("node", "i", "j").applyInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have den * intersection >= num * union; row by row, as two sets of long texts are large."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("right"))
    sizes = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("left").cast("long").alias("m"), F.size("right").cast("long").alias("n"), F.size(F.array_intersect("left", "right")).alias("both"))
    return sizes.where(f"{den} * both >= {num} * (m + n - both)").select("a", "b")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(v, comp) for every end of a link: comp is the least v reachable.

    Each round takes the least label of the neighbours and then the label of
    that label, so the label of a path of n vertices settles in about log n
    rounds.  ``labels`` (v, comp) may give labels of earlier links.
    """
    if labels is not None:
        links = links.unionByName(labels.select(F.col("comp").alias("a"), F.col("v").alias("b")).where("a <> b"))
    both = staged(links.select("a", "b").union(links.select("b", "a")).toDF("v", "u").distinct(), "near-edges")
    now = both.groupBy("v").agg(F.least("v", F.min("u")).alias("comp"))
    now = staged(now.withColumn("moved", F.lit(True)), "near-labels")
    while not now.where("moved").isEmpty():
        around = both.join(now.select(F.col("v").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        step = now.select("v", F.col("comp").alias("was")).join(around, "v").select("v", "was", F.least("was", "near").alias("comp"))
        up = now.select(F.col("v").alias("comp"), F.col("comp").alias("above"))
        step = step.join(up, "comp", "left").select("v", F.least("comp", F.coalesce("above", "comp")).alias("comp"), "was")
        now = staged(step.select("v", "comp", (F.col("comp") < F.col("was")).alias("moved")), "near-labels")
    return now.select("v", "comp")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, trees: int | None = None, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id, component_id, kept, first for every document.

    Two documents are linked if den * intersection >= num * union of their
    k-word shingle sets.  class_id is the least doc_id with the same set; kept
    says that doc_id is component_id, first that no row of the component has a
    lesser doc_id and text_key.
    """
    ship(docs.sparkSession)
    trees = trees or trees_for(num / den, depth)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    keyed = staged(sketches(rows, k, trees, depth), "near-sketches")
    some = keyed.where("n > 0 and doc_id is not null")
    row = F.struct("doc_id", "text_key")
    reps = some.groupBy("n", "s1", "s2").agg(F.min(row).alias("row"), F.min_by(F.struct("paths", "sketch"), row).alias("x"))
    reps = staged(reps.select(F.monotonically_increasing_id().alias("cls"), "row", "n", "s1", "s2", "x.paths", "x.sketch"), "near-reps")
    members = _members(reps, trees, depth, leaf).join(reps.select("cls", "n", "sketch"), "cls")
    members = staged(members, "near-members")
    large = members.where(F.col("size") > leaf).select("node", "cls", "n", "sketch")

    picks = [F.min_by(F.struct("cls", "comp", "n", "sketch"), F.xxhash64("cls", F.lit(j))).alias(f"h{j}") for j in range(PIVOTS)]
    every = large.withColumn("comp", F.col("cls"))
    hubs = every.groupBy("node").agg(*picks).select("node", F.array_distinct(F.array(*[f"h{j}" for j in range(PIVOTS)])).alias("hubs"))
    pairs = _leaf_pairs(members.where(F.col("size") <= leaf), num, den).unionByName(_star_pairs(every, hubs, num, den))
    pairs = staged(pairs.groupBy("a", "b").agg(F.max("best").alias("best")), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(large.select("cls")).distinct()
    wanted = reps.select("cls", "row.*").join(wanted, "cls")
    texts = rows.join(wanted, ["doc_id", "text_key"])  # the only shuffle of texts
    sets = staged(full_sets(texts, k).dropDuplicates(["cls"]), "near-sets")
    links = staged(_verified(pairs.where("best"), sets, num, den), "near-links")
    labels = components(links)

    rest = pairs.where("not best").select("a", "b")
    for side in ("a", "b"):
        rest = rest.join(labels.select(F.col("v").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
    rest = staged(rest.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "near-rest")
    links = links.unionByName(staged(_verified(rest, sets, num, den), "near-links"))
    if not large.isEmpty():
        named = large.select("node", "cls").join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        parts = named.groupBy("node", "comp").agg(F.count("*").alias("c"))
        state = parts.groupBy("node").agg(F.sum("c").alias("size"), F.max_by("comp", "c").alias("main"), F.max("c").alias("most"))
        opened = staged(named.join(state.where("most < size"), "node"), "near-open")
        met = _block_links(opened, sets, num, den)
        links = links.unionByName(staged(met.distinct(), "near-links"))
    labels = components(links, labels)

    settled = reps.select("n", "s1", "s2", "cls", "row").join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    settled = staged(settled.drop("cls"), "near-settled")
    least = settled.groupBy("comp").agg(F.min("row").alias("least"))
    named = settled.join(least, "comp").select("n", "s1", "s2", F.col("row.doc_id").alias("class_id"), "least")
    joined = some.select("doc_id", "text_key", "n", "s1", "s2").join(named, ["n", "s1", "s2"])
    alone = keyed.where("n = 0 or doc_id is null").select("doc_id", "text_key", "n", F.col("doc_id").alias("class_id"), row.alias("least"))
    return joined.select("doc_id", "text_key", "n", "class_id", "least").unionByName(alone).select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        "class_id",
        F.col("least.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("least.doc_id"), F.lit(True)).alias("kept"),
        F.expr("doc_id <=> least.doc_id and text_key = least.text_key").alias("first"),
    )
