"""The analysis as a stream: files of texts in, one report for each document out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import jobs, rules

REPORT = ["doc_id", "document_type", "confidence", "profile_name", "total_rules", "error_count", "warning_count", "is_complete", "completeness_score", "status", "error_message"]


def analyse(docs: DataFrame, by_type: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The report of each document, and its columns ``keep``: extraction, rules, scores. Lazy, row by row, no shuffle."""
    return jobs.analysed(docs, by_type).select(*REPORT, *keep)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, by_type: DataFrame, schema: str = "doc_id long, text string, sent_at timestamp") -> StreamingQuery:
    """Analyse new files of ``source`` as they come. A batch that runs again writes the same folder again.

    Readers of the sink take :func:`latest`, so documents that arrive twice have one report.
    """

    def write(batch: DataFrame, number: int) -> None:
        analyse(batch, by_type, ("sent_at",)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(reports: DataFrame) -> DataFrame:
    return rules.upsert(reports.limit(0), reports, "doc_id", "sent_at")
