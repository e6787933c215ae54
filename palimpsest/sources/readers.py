"""Sources: labelled text folders, files as bytes, a seeded corpus, and the recognition boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.llm.common import bound_batches

FILES = "path string, content binary"
PAGES = "array<array<struct<text:string,x:int,y:int,width:int,height:int>>>"
#: Words that a worker holds before their rows go back to Spark; a row with more of them goes alone.
HELD_WORDS = 1 << 14


def labelled_folders(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(label, text) of ``path/split/label/*.txt``; the folder is the label, blank files do not count."""
    rows = spark.read.text(f"{path}/{split}/*/*.txt", wholetext=True)
    label = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select(label.alias("label"), F.expr(T.strip("value")).alias("text")).where("text <> ''")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def recognised(docs: DataFrame, engine: Callable[[bytes, str], list] | None = None) -> DataFrame:
    """Pages of words of each row's (path, content) by an engine (content, path) -> pages; other columns stay.

    An engine's failure stays in the row's ``error``, as does a missing content. A worker's memory is bounded by
    ``BATCH_BYTES`` of files, ``HELD_WORDS`` words and what a single file needs beyond them, not by rows.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "content"]
    rows = docs.select(*kept, "content").withColumns({"pages": F.expr(f"CAST(NULL AS {PAGES})"), "error": F.lit(None).cast("string")})

    def one(content: bytes | None, path: str) -> tuple[list, str | None]:
        if content is None:
            return [], "there is no file"
        if engine is None:
            return [], "no recognition engine is configured"
        try:
            return engine(content, path), None
        except Exception as e:
            return [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, got, held = 0, [], 0
            for i in range(batch.num_rows):
                got.append(one(batch["content"][i].as_py(), batch["path"][i].as_py()))
                held += sum(len(words or ()) for words in got[-1][0] or ())
                if held >= HELD_WORDS or i + 1 == batch.num_rows:
                    pages = pa.array([p for p, _ in got], batch.schema.field("pages").type)
                    errors = pa.array([e for _, e in got], pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(got)).select(kept).columns, pages, errors], [*kept, "pages", "error"])
                    start, got, held = i + 1, [], 0

    return rows.mapInArrow(run, rows.drop("content").schema)


class TooLarge(ValueError):
    """A page rendered at this zoom has too many pixels."""


def zoomed(engine: Callable[[bytes, str, float], list], dpi: int = 150, attempts: int = 3) -> Callable[[bytes, str], list]:
    """An engine for one page, rendered at a zoom: if that is too large, again at 2/3 of it, thrice at most; 1.5 is the last."""

    def run(content: bytes, path: str) -> list:
        zoom = dpi / 72
        for left in reversed(range(attempts)):
            try:
                return engine(content, path, zoom)
            except TooLarge:
                if not left or zoom <= 1.5:
                    raise
                zoom /= 1.5
        return []

    return run


def synthetic_splits(spark: SparkSession, classes: dict[str, str], train: int = 200, valid: int = 60, seed: int = 42) -> DataFrame:
    """(split, label, i, text): the seeded corpus to train on, and one of another seed to validate."""
    both = [synthetic_corpus(spark, classes, n, s).withColumn("split", F.lit(name)) for name, n, s in (("train", train, seed), ("valid", valid, seed + 1000))]
    return both[0].unionByName(both[1]).select("split", "label", "i", "text")


def synthetic_corpus(spark: SparkSession, classes: dict[str, str], each: int = 200, seed: int = 42, words: int = 40) -> DataFrame:
    """(label, i, text): for each class, texts of its words in an order that the seed fixes."""
    table = spark.createDataFrame([(c, w.split()) for c, w in classes.items()], "label string, vocabulary array<string>")
    pick = f"transform(sequence(1, {words}), k -> vocabulary[CAST(pmod(xxhash64({seed}, label, i, k), size(vocabulary)) AS INT)])"
    return table.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).select("label", "i", F.expr(f"array_join({pick}, ' ')").alias("text"))
