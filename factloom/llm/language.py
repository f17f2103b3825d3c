"""Language identification by bit-sliced Bloom filters of n-grams.

Text is lowered, runs of other characters than letters become one space, and
the n-grams of ``ORDERS`` characters hash to 64 bits.  A language contains an
n-gram that is at least ``SHARE`` of its n-grams and at least ``PART`` of the
n-gram's largest share in any language; so a language has at most 1/SHARE of
them, at any size of the corpus.  One table of ``2**SLOT_BITS`` masks, a bit per
language, is the Bloom filters of all languages side by side: the AND of an
n-gram's ``PROBES`` slots is the set of languages containing it.  A document's
count for a language, less what the filter's fill makes expect by chance,
decides.

The model is learned from at most about ``ROWS`` labelled documents, taken by a
hash of their ids; predictions read every document whole, in pieces that share
their last characters.

Defined cases: null text, and text without a letter, is ``und`` with score 0;
text with letters but no known n-gram gets the first language, score 0; ties go
to the first language by code point; rows with null lang are not learned from;
repeated rows are predicted alike and each counts in learning; a null doc_id is
neither held out nor learned from; without labelled rows all is ``und``; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shingles import mix, odd_multipliers, slices
from factloom.shipping import ship

ORDERS, SHARE, PART = (2, 3, 4), 2e-5, 0.02
SLOT_BITS, PROBES, ROWS = 20, 3, 30_000
FOLDS = 5
PIECE, SLICE, HELD = 1 << 17, 1 << 18, 2_000_000  # n-grams hashed at once, bytes of text at once, counts held in a task

_SALT = odd_multipliers(max(ORDERS) + PROBES, seed=5)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points that count, the text each comes from, and each text's number of letters."""
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered], dtype=np.int64)
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    text = np.repeat(np.arange(len(texts), dtype=np.uint32), size)
    letter = _is_letter()[code]
    counts = np.bincount(text[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter
    return np.where(letter, code, np.uint32(0x20))[keep], text[keep], counts


def grams(code: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams and the text each comes from, one order and at most PIECE of them at a time."""
    for low in range(0, len(code), PIECE):
        for n in ORDERS:
            part, owner = code[low : low + PIECE + n - 1], text[low : low + PIECE + n - 1]
            rows = len(part) - n + 1
            if rows > 0:
                total = np.full(rows, n, dtype=np.uint64)
                for j in range(n):
                    total += part[j : j + rows] * _SALT[j]
                whole = owner[:rows] == owner[n - 1 :]
                yield mix(total[whole]), owner[:rows][whole]


def _slot(hashes: np.ndarray, probe: int) -> np.ndarray:
    return (hashes * _SALT[max(ORDERS) + probe]) >> np.uint64(64 - SLOT_BITS)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the table of masks, from documents outside fold 0."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    labelled = docs.where("lang is not null and text is not null").where(fold != 0).select("doc_id", "text", F.col("lang").cast("string"))
    rows = labelled.select("doc_id").count()
    if rows > ROWS:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * ROWS / rows)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        size = 0

        def add(lang: str, hashes: np.ndarray) -> None:
            nonlocal size
            parts[lang].append(np.unique(hashes, return_counts=True))
            size += len(parts[lang][-1][0])

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, held in parts.items():
                keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([c for _, c in held])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int8))), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for low, high in slices(batch.column("text"), SLICE):
                by: dict[str, list[str]] = defaultdict(list)
                for lang, text in zip(batch.column("lang")[low:high].to_pylist(), batch.column("text")[low:high].to_pylist()):
                    by[lang].append(text)
                for lang, texts in by.items():
                    code, text, _ = _codes(texts)
                    for hashes, _ in grams(code, text):
                        add(lang, hashes)
                if size > HELD:
                    yield from merged()
                    parts.clear()
                    size = 0
        yield from merged()

    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= SHARE)
    best = shares.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("found"), F.max("share").alias("top"))
    kept = best.select("gram", F.inline("found"), "top").where(F.col("share") >= PART * F.col("top")).select("lang", "gram")
    bounded = kept.toPandas()  # at most 1 / SHARE n-grams of each language
    languages = sorted(bounded["lang"].unique(), key=lambda x: [ord(c) for c in x])
    masks = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    for i, lang in enumerate(languages):
        keys = bounded.loc[bounded["lang"] == lang, "gram"].to_numpy(dtype=np.int64).view(np.uint64)
        for probe in range(PROBES):
            at = _slot(keys, probe)
            masks[at, i // 64] |= np.uint64(1 << (i % 64))
    return languages, masks


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    ship(docs.sparkSession)
    languages, masks = learn(docs)
    bit = [(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
    chance = np.array([float(b.mean()) ** PROBES for b in bit])
    shared = docs.sparkSession.sparkContext.broadcast((languages, masks, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, masks, chance = shared.value
        for batch in batches:
            for low, high in slices(batch.column("text"), SLICE):
                texts = [t or "" for t in batch.column("text")[low:high].to_pylist()]
                code, text, letters = _codes(texts)
                n, counts = np.zeros(len(texts)), np.zeros((len(texts), max(1, len(languages))))
                for hashes, owner in grams(code, text):
                    found = masks[_slot(hashes, 0)]
                    for probe in range(1, PROBES):
                        found &= masks[_slot(hashes, probe)]
                    n += np.bincount(owner, minlength=len(texts))
                    for i in range(len(languages)):
                        has = ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                        counts[:, i] += np.bincount(owner[has], minlength=len(texts))
                hits = np.maximum(counts - n[:, None] * chance, 0) / (1 - chance + 1e-12) if languages else counts
                best = hits.argmax(axis=1)
                score = np.clip(np.where(n > 0, hits[np.arange(len(texts)), best] / np.maximum(n, 1), 0), 0, 1)
                known = (letters > 0) & bool(languages)
                pred = [languages[b] if k else "und" for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], batch.column("held_out")[low:high], pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
