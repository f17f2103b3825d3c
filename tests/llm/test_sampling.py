"""Whitening, importance resampling and removal of repeated passages against brute force and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import resampling, suffix_dedup, whitening

# --- whitening ---


def brute_whiten(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (n * x - sums).astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], basis[:, ::-1]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component string")


def test_whitening_against_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    given = {r.vec_id: r.embedding for r in table.collect()}
    ids = sorted(given)
    deviation, centred, values, basis = brute_whiten([given[i] for i in ids])
    found = whitening.whiten(table).toPandas().sort_values(["vec_id", "component"])
    k = min(32, len(ids) - 1)
    assert len(found) == k * len(ids)
    z = found.whitened.to_numpy().reshape(len(ids), k)
    expected = centred @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign((z * expected).sum(axis=0))
    assert np.allclose(z, expected * signs, atol=1e-6)
    assert found.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == deviation.tolist()
    assert np.allclose(found.explained.to_numpy().reshape(-1, k)[0], values[:k] / values.sum(), rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-8
    assert np.abs(z.T @ z / len(ids) - np.eye(k)).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0, 3.0], "x", "y"), (2, [2.0, 1.0, -1.5], "x", None), (2, [2.0, 1.0, -1.5], "x", None), (None, [0.5, 0.25, 9.0], None, "y"),
        (3, None, "x", "y"), (4, [1.0, None, 2.0], "x", "y"), (5, [float("nan"), 0.0, 0.0], "x", "y"), (6, [float("inf"), 0.0, 0.0], "x", "y"),
        (7, [1.0, 2.0], "x", "y"), (8, [], "x", "y"), (9, [3e38, 0.0, 0.0], "x", "y"),
    ]
    found = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r.vec_id for r in found} == {1, 2, None}
    assert Counter(r.vec_id for r in found) == {1: 2, 2: 4, None: 2}  # four points of three distinct places lie in a plane
    deviation = brute_whiten([rows[0][1], rows[1][1], rows[1][1], rows[3][1]])[0]
    assert {(r.vec_id, r.deviation) for r in found} == {(1, deviation[0]), (2, deviation[1]), (None, deviation[3])}
    assert all(r.n == 4 for r in found)


def test_whitening_without_spread(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0], None, None)])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(i, [1.0, 2.0], None, None) for i in range(3)])).collect() == []
    line = whitening.whiten(vectors_of(spark, [(i, [float(i)], None, None) for i in range(3)])).collect()
    assert sorted(round(abs(r.whitened), 9) for r in line) == [0.0, round(1.5**0.5, 9), round(1.5**0.5, 9)]


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 0]])
    exact, rough = whitening._deviations(x, 2, x.sum(axis=0))
    assert list(exact) == [None, None] and rough.tolist() == [float(1 << 80)] * 2


# --- importance resampling ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(docs, target, n=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, n)[1]))
    for text in target:
        t.update(map(bucket, features(text, n)[1]))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    return Counter([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least])


def resampled(docs, target, **how):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs, target, **how).collect())


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_against_brute_force(spark, frame, odd_rows, n):
    target = ["the cat and the dog", "Ünïcödé wörds wait", None]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    docs = [(r[0], r[1]) for r in odd_rows]
    assert resampled(frame(odd_rows), wanted, n=n, least=2, percent=50) == brute_resample(docs, target, n=n, least=2, percent=50)


def test_resampling_of_a_table(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert resampled(docs, target) == expected


def test_resampling_of_empty_tables(frame, odd_rows):
    assert resampled(frame([]), frame([])) == Counter()
    docs = [(r[0], r[1]) for r in odd_rows]
    assert resampled(frame(odd_rows), frame([])) == brute_resample(docs, [])


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 7, 64])
def test_chunks_own_each_feature_once(n, size):
    rng = random.Random(n * size)
    text = " ".join(rng.choice(["a", "bb", "Ç", "x-y", "longer" * 4]) for _ in range(200)) + "  "
    lowered, got = text.encode().lower(), []
    for owned, body in resampling.cut(lowered, n, size):
        got += resampling._features(body, owned, n)[1]
    assert Counter(f.decode() for f in got) == Counter(features(lowered.decode(), n)[1])


# --- repeated passages ---


def brute_passages(docs, width):
    least = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - width + 1 if doc_id is not None else 0):
            s = data[i : i + width]
            least[s] = min(least.get(s, doc_id), doc_id)
    rows = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - width + 1 if doc_id is not None else 0):
            if least[data[i : i + width]] < doc_id:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        rows.append((doc_id, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return Counter(rows)


def passages(docs, **how):
    return Counter(tuple(r) for r in suffix_dedup.repeated_passages(docs, **how).collect())


def tangled(seed, n=60):
    """Texts that share passages at random places, periodic stretches, multi-byte letters and NULs."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé\x00 ") for _ in range(rng.randint(5, 60))) for _ in range(12)] + ["ab" * 40, "z" * 90]
    return [(rng.randint(0, n // 2) if rng.random() < 0.95 else None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), "en", "s") for _ in range(n)]


@pytest.mark.parametrize("many", [0, 3, 512])
def test_passages_against_brute_force(spark, frame, many):
    rows = tangled(many)
    docs = [(r[0], r[1]) for r in rows]
    assert passages(frame(rows), many=many, groups=5, buckets=3) == brute_passages(docs, 50)
    assert passages(frame(rows), width=20, gram=9, many=many, groups=3, buckets=2) == brute_passages(docs, 20)


def test_passages_of_odd_rows_and_a_table(spark, sf, frame, odd_rows):
    assert passages(frame(odd_rows)) == brute_passages([(r[0], r[1]) for r in odd_rows], 50)
    assert passages(frame([])) == Counter()
    assert passages(frame([(1, None, None, None)])) == brute_passages([(1, None)], 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert passages(docs) == brute_passages([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_passages_of_pieces_with_equal_marks(spark, frame):
    """Two documents of a group that hold a string in pieces whose short marks agree are still two documents."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared, cut, met, pair = letters(50), suffix_dedup.Runs(50, 31), {}, None
    while pair is None:
        text = letters(25) + shared + letters(25)
        start, count, _, _, form = cut(np.frombuffer(text.encode(), np.uint8), np.array([100]), np.array([False]))
        mark = int(form[(start <= 25) & (25 < start + count)][0]) & 0xFFFE
        pair = (met[mark], text) if mark in met else None
        met[mark] = text
    docs = list(enumerate(pair))
    assert passages(frame([(i, t, None, None) for i, t in docs]), groups=1, buckets=1) == brute_passages(docs, 50)


@pytest.mark.parametrize("seed", range(4))
def test_transform_and_common_prefixes_of_a_collection(tmp_path, seed):
    """Column by column equals sorting all suffixes, the marks in their order before any symbol."""
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20))) for _ in range(60)]
    marks = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(3, 9))) for _ in strings]
    lengths = np.array([len(s) for s in strings])
    columns = np.zeros((lengths.max(), len(strings)), np.uint8)
    for i, s in enumerate(strings):
        for j in range(len(s)):
            columns[j, i] = s[len(s) - 1 - j] + 1
    sizes = np.array([len(m) for m in marks])
    order, common = suffix_dedup._marks(np.frombuffer(b"".join(marks), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes))
    by_mark = sorted(range(len(marks)), key=lambda i: (marks[i], i))
    assert order.tolist() == by_mark
    shared = lambda a, b: next((d for d, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0] + [shared(marks[a], marks[b]) for a, b in zip(by_mark, by_mark[1:])]
    rounds = suffix_dedup.Rounds(f"file://{tmp_path}", "c")
    transform, common = suffix_dedup.build(columns, lengths, order, common, rounds)
    place = {i: p for p, i in enumerate(by_mark)}
    spelt = lambda i, j: [*(b + len(marks) for b in strings[i][j:]), place[i]]  # noqa: E731  a mark is one letter, before all symbols
    suffixes = sorted(((i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)), key=lambda x: spelt(*x))
    assert transform.tolist() == [strings[i][j - 1] + 1 if j else 0 for i, j in suffixes]

    def together(x, y):
        a, b = (strings[i][j:] for i, j in (x, y))
        d = shared(a, b)
        return d + shared(marks[x[0]], marks[y[0]]) if d == len(a) == len(b) else d

    assert common.tolist() == [0] + [together(x, y) for x, y in zip(suffixes, suffixes[1:])]
    rounds.delete()
    assert list(tmp_path.iterdir()) == []


def test_a_string_has_one_key_wherever_it_stands():
    rng = random.Random(5)
    cut = suffix_dedup.Runs(50, 31)
    data = bytes(rng.choice(b"ab cd") for _ in range(3000)) + b"q" * 300
    data = np.frombuffer(data[:1500] + data, np.uint8)
    start, count, left, key, _ = cut(data, np.array([700, len(data)]), np.array([False, False]))
    keys = defaultdict(set)
    for s, c, p, k in zip(start, count, left, key):
        for i in range(s, s + c):
            keys[data[i : i + 50].tobytes()].add((int(k), int(s + p - i)))
    assert all(len(v) == 1 for v in keys.values()) and sum(count) == 700 - 49 + len(data) - 700 - 49
