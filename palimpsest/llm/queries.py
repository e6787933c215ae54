"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, fingerprint, html_text, nearest, packing, pseudonyms, secrets, simhash, token_file, toxicity
from palimpsest.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_spec())


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.read_file(token_file.write_file(table(spark, sf_dir, "documents"), bpe.read_spec()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return nearest.search(vectors, vectors.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = F.col("score")
    return toxicity.scores(docs, model).select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), score, (score >= 0.5).cast("int").alias("predicted"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


#: The key of the registered query; a real run gets its own from a secret store.
EXAMPLE_KEY = "example key of the registered query"


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, EXAMPLE_KEY)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_nearest": op2_nearest,
    "op3_packing": op3_packing,
    "op4_fingerprint": op4_fingerprint,
    "op5_token_file": op5_token_file,
    "op6_secrets": op6_secrets,
    "op7_html": op7_html,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_pseudonyms": op10_pseudonyms,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {}
