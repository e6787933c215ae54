"""Python workers hold a bounded part of a table at a time, whatever the number of its rows."""

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

from palimpsest.functions import text as T
from palimpsest.operators import classify
from palimpsest.plans import catalog
from palimpsest.sources import readers

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT)


def largest_batch(spark):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    long = spark.range(0, 300, 1, 1).selectExpr("repeat('word ', 20000) AS text")
    return max(r.n for r in long.mapInArrow(batch_sizes, "n long").collect())


def test_recognition_holds_few_words(unbounded):
    class Word(dict):
        alive = 0

        def __init__(self):
            Word.alive += 1
            super().__init__(text="w", x=Word.alive, y=0, width=1, height=1)

        def __del__(self):
            Word.alive -= 1

    docs = unbounded.range(0, 100, 1, 1).selectExpr("CAST(id AS STRING) AS path", "CAST('x' AS BINARY) AS content")
    rows = readers.recognised(docs, lambda content, path: [[Word() for _ in range(1000)], []]).selectExpr("path", "size(flatten(pages)) AS n", "array_max(transform(pages[0], w -> w.x)) AS held", "size(pages) AS pages").collect()
    assert sorted(int(r.path) for r in rows) == list(range(100)) and {(r.n, r.pages) for r in rows} == {(1000, 2)}
    assert max(r.held for r in rows) < 40_000


def test_recognition_takes_few_bytes_of_files(unbounded):
    docs = unbounded.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    assert readers.recognised(docs, lambda content, path: [None, []]).first().pages == [None, []]
    assert largest_batch(unbounded) < 4 << 20


def test_classifier_text_goes_text_by_text():
    texts = pd.Series(["Wórd, " * 10000] * 100, dtype=object)
    tracemalloc.start()
    try:
        (got,) = T.classifier_text.func(iter([texts]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[99] == " ".join(["word"] * 10000)
    assert peak < 3 * sum(map(len, texts))


def test_classifier_text_takes_few_bytes(unbounded, data):
    assert catalog.classifier_text(unbounded, data).first().clean_md5
    assert largest_batch(unbounded) < 4 << 20


def test_classifier_takes_few_bytes_of_texts(unbounded):
    corpus = readers.synthetic_corpus(unbounded, {"invoices": "faktura vat", "contracts": "umowa strony"}, each=4)
    model = classify.train(corpus, rounds=2)
    assert largest_batch(unbounded) < 4 << 20
    unbounded.conf.unset(LIMIT)
    assert classify.classify(corpus, model).count() == 8
    assert largest_batch(unbounded) < 4 << 20
