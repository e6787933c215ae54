"""The life of an analysis, from the request to the report, as columns of its row.

Whatever goes wrong with a row stays in the row: its status is a failure, ``error_message`` says why, and it keeps the
stage it came to. No row fails the job of the others. All of it is lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import classify, formal, rules
from palimpsest.sources import readers

#: The stages of a legal analysis, in order.
LEGAL_STAGES = ("local_ocr", "redaction", "azure_ocr", "llm_analysis")
#: Routes of requests. The local one leaves the document's status alone.
ROUTES = ("local", "azure", "full", "legal")

Work = Callable[[DataFrame], DataFrame]


def requested(docs: DataFrame, route: str, key: str = "doc_id") -> DataFrame:
    """A pending analysis for each document, with the status that the document gets."""
    if route not in ROUTES:
        raise ValueError(f"routes are {', '.join(ROUTES)}")
    own = F.col("status") if "status" in docs.columns else F.lit("uploaded")
    return docs.select(
        F.col(key).alias("document_id"),
        F.lit(route).alias("route"),
        F.lit("pending").alias("status"),
        F.lit("pending").alias("processing_stage"),
        F.lit(0).alias("processing_step"),
        F.lit(None).cast("string").alias("error_message"),
        (own if route == "local" else F.lit("queued")).alias("document_status"),
    )


def redacted_path(path: Column) -> Column:
    """The file beside ``path`` that its redacted version is moved to."""
    return F.concat(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.lit("redacted_"), F.regexp_extract(path, r"([^/]*)$", 1))


def recognised(analyses: DataFrame, engine: Callable[[bytes, str], list] | None = None) -> DataFrame:
    """Recognition of each row's (path, content): pages, and the status that follows, for local and cloud engines alike."""
    rows = readers.recognised(analyses, engine)
    return rows.withColumns({"status": F.when(F.col("error").isNull(), "ocr_completed").otherwise("ocr_failed"), "error_message": F.col("error")}).drop("error")


def advance(rows: DataFrame, works: list[tuple[str, Work]]) -> DataFrame:
    """Take each row through the stages. A stage's work adds columns and ``error`` (null: it went well).

    Rows that failed see the later works too, as lazy columns must, but keep their stage, step and first error.
    """
    rows = rows.withColumns({"processing_stage": F.lit("pending"), "processing_step": F.lit(0), "error_message": F.lit(None).cast("string")})
    for step, (name, work) in enumerate(works, 1):
        alive = F.col("error_message").isNull()
        here = {"processing_stage": F.when(alive, name).otherwise(F.col("processing_stage")), "processing_step": F.when(alive, step).otherwise(F.col("processing_step"))}
        rows = work(rows.withColumns(here))
        rows = rows.withColumn("error_message", F.coalesce("error_message", "error")).drop("error")
    failed = F.col("error_message").isNotNull()
    return rows.withColumns({"status": F.when(failed, "ocr_failed").otherwise("completed"), "processing_stage": F.when(failed, F.col("processing_stage")).otherwise("completed")})


def analysed(docs: DataFrame, by_type: DataFrame, classifier: Work | None = None) -> DataFrame:
    """Extraction, classification, rules, report and summary of each document's text.

    classifier adds model_type and model_confidence (null: it has no answer, as for empty text); without one, and where
    it has no answer, the keywords decide. A document whose profile holds a pattern that is no regular expression has
    status ``failed``, the error, and no report.
    """
    rows = formal.extract(docs)
    if classifier:
        rows = classify.with_fallback(classifier(rows))
    rows = rules.summarised(rules.report(rules.issues(rows, by_type)))
    failed = F.col("broken").isNotNull()
    report = ("issues", "error_count", "warning_count", "info_count", "is_complete", "completeness_score", "summary")
    rows = rows.withColumns({c: F.when(~failed, F.col(c)) for c in report})
    return rows.withColumns({"status": F.when(failed, "failed").otherwise("completed"), "error_message": F.col("broken"), "document_status": F.when(failed, "queued").otherwise("processed")}).drop("broken")
