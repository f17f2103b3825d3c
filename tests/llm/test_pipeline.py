"""The pipeline on the small tables: stages filter as they say, and the rest keeps the documents' columns."""

from collections import Counter

import corpus_pipeline as pipeline

from factloom.scratch import staged


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_stages_on_odd_rows(spark, sf, frame, odd_rows):
    """Null ids, repeated rows and different texts under one id, through each stage alone and all in turn."""
    twin = "It was written down with care, and every reader of the book has since agreed that the story is true, however odd"
    rows = [*odd_rows, (1, twin + " it may sound.", "en", "a"), (20, twin + " it may seem.", "en", "a"), (20, "Another text of the id 20, with words of its own.", "en", "b"), (None, "one more without an id", "en", "a")]
    docs = frame(rows)
    given = Counter(rows)

    exact = rows_of(pipeline.exact_duplicates(spark, docs, sf))
    lowered = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert set(exact) <= set(given) and set(exact.values()) == {1}
    assert Counter(lowered(r[1]) for r in exact) == Counter({lowered(r[1]) for r in rows})

    near = rows_of(pipeline.near_duplicates(spark, docs, sf))
    gone = {r[:2] for r in given - near}
    assert gone == {(2, rows[1][1]), (7, "one two"), (20, twin + " it may seem.")} and not near - given

    mixed = rows_of(pipeline.source_mix(spark, docs, sf))
    assert all(0 < n <= 3 * given[r] for r, n in mixed.items())
    alone = frame([(None, f"text {i} of no id, of seven words", "en", None if i % 2 else "s") for i in range(40)] + [(5, "twice the same row", "en", "t")] * 2)
    got = rows_of(pipeline.source_mix(spark, alone, sf))
    assert sum(n for r, n in got.items() if r[0] is None) > 20 and all(n <= 3 * (2 if r[0] == 5 else 1) for r, n in got.items())

    assert rows_of(pipeline.quality_rules(spark, docs, sf)) <= given
    packed = pipeline.packed(spark, docs, sf)
    assert packed.where("start = 0").count() == len(rows)
    for _, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), "test-odd")
        assert docs.columns == pipeline.COLUMNS
